"""Helpers that the operators of this subpackage share: tables in the shared folder and text rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`).

    Only a local session may go without that setting; it gets a temporary folder, once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/reelspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends here, and lost executors cost nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that is no longer used back to the system; Python workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over Arrow batches, with `release` after each batch."""

    def out(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                release()

        yield from run(each())
        release()

    return out


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty. Texts of ASCII alone take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text_col: str) -> Column:
    """A hash that tells different texts under one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def only_ids(rows: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows whose `key` is in `ids` (a stored table of distinct keys).

    The ids are broadcast if a count proves them few; otherwise both sides are shuffled.
    """
    few = ids.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], limit: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` less the rows whose `keys`, by their names in `gone`, are all equal to a row's there; null equals null. Same columns.

    `gone` is broadcast if a count proves it small, so that no text is shuffled; otherwise both sides are.
    """
    taken = {c.lower() for c in docs.columns}
    free = {k: next(n for n in (f"{k}_{i}" for i in range(len(taken) + 1)) if n.lower() not in taken) for k in keys}
    marked = docs.withColumns({free[k]: c for k, c in keys.items()})
    gone = stored(gone.select(*[F.col(k).alias(f"gone_{i}") for i, k in enumerate(keys)]), "gone")
    gone = F.broadcast(gone) if gone.limit(limit + 1).count() <= limit else gone
    same = [F.col(f"d.{free[k]}").eqNullSafe(F.col(f"g.gone_{i}")) for i, k in enumerate(keys)]
    return marked.alias("d").join(gone.alias("g"), same, "left_anti").drop(*free.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
