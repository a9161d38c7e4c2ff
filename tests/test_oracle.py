"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from reelspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return ""
        return repr(float(x)) if isinstance(x, int | float) or hasattr(x, "dtype") else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(plans.QUERIES) >= 50
