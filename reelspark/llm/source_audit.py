"""Divergence of sources within a language, by a frequent-pattern tree of term rows.

The row of a term is its counts above 0 by source, in order of the sources. Rows with equal beginnings share a path of a
tree whose nodes (source, count) know how many terms run through them. The difference of two sources, summed over
all terms, is what it would be without any counts, plus a correction for each count by itself and one for each two counts
that meet in a row; the latter are added once for each node and ancestor, times the node's terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import lean, stored
from reelspark.llm.terms import LETTERS_ONLY, terms

SCALE, PRIOR = 1_000_000_000, 5
#: Different terms of sources that a task counts before it gives them on; cells (rows by sources) of one tree, which has eight rows for each source at least.
HELD, CELLS = 1 << 18, 1 << 16


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df), partial: occurrences and documents of each term, and for each group an empty term with 0."""

    def give(held: dict):
        for (lang, source), (n, df) in held.items():
            keys = list(n)
            cols = [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(n.values()), pa.int64()), pa.array([df[k] for k in keys], pa.int64())], names=["lang", "source", "term", "n", "df"])
        held.clear()

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for group, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if group not in held:
                    held[group] = Counter({b"": 0}), Counter()
                n, df = held[group]
                words, before = terms(text, LETTERS_ONLY), len(n)
                n.update(words)
                df.update(set(words))
                size += len(n) - before
                if size >= HELD:
                    yield from give(held)
                    size = 0
        yield from give(held)

    none = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), none).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "lang string, source string, term string, n long, df long")


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * v)), exactly."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"), (total + PRIOR * v).cast("decimal(20,0)"))


def shares(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """As `_share`, by long division in three steps of three digits, so that nothing overflows."""
    whole = total + PRIOR * v
    out, rest = np.divmod(n + PRIOR, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def tree_differences(source: np.ndarray, count: np.ndarray, offsets: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """[a, b]: the sum of |p_a - p_b| over the rows given (sources ascending within a row), for all sources of a language."""
    k, n_rows = len(totals), len(offsets) - 1
    p0 = shares(np.zeros(k, dtype=np.int64), totals, v)
    base = np.abs(p0[:, None] - p0[None, :])
    out = n_rows * base
    if not len(source):
        return out
    # one code for each different (source, count)
    pair, code = np.unique(np.stack((source, count)), axis=1, return_inverse=True)
    code, of = code.reshape(-1), pair[0]
    p = shares(pair[1], totals[of], v)
    size = np.diff(offsets)
    rows = np.full((n_rows, size.max(initial=0)), -1, dtype=np.int64)
    rows[np.repeat(np.arange(n_rows), size), np.arange(len(code)) - np.repeat(offsets[:-1], size)] = code
    rows = rows[np.lexsort(rows.T[::-1])]
    times = np.bincount(code, minlength=len(p))
    for a in range(0, len(p), max(1, CELLS // k)):
        part = slice(a, a + max(1, CELLS // k))
        alone = (np.abs(p[part, None] - p0[None, :]) - base[of[part]]) * times[part, None]
        np.add.at(out, of[part], alone)
        np.add.at(out.T, of[part], alone)
    met = np.zeros((k, k), dtype=np.int64)
    changed = np.zeros(n_rows, dtype=bool)
    changed[0] = True
    for d in range(rows.shape[1]):
        changed[1:] |= rows[1:, d] != rows[:-1, d]
        begins = np.flatnonzero(changed)
        through = np.diff(np.append(begins, n_rows))
        node = rows[begins, d] >= 0
        begins, through = begins[node], through[node]
        here = rows[begins, d]
        for e in range(d):
            up = rows[begins, e]
            x, y, x0, y0 = p[up], p[here], p0[of[up]], p0[of[here]]
            np.add.at(met, (of[up], of[here]), through * (np.abs(x - y) - np.abs(x - y0) - np.abs(x0 - y) + np.abs(x0 - y0)))
    out += met + met.T
    np.fill_diagonal(out, 0)
    return out


def _pair_sums(kept: DataFrame, info: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of every two sources of a language, from trees of bounded size."""
    k = F.size("sources")
    parts = F.greatest(F.lit(1), F.ceil(F.col("v") / F.greatest(F.lit(CELLS) / k, 8 * k))).cast("int")
    info = info.withColumn("parts", parts)
    left = kept.join(info.select("lang", "parts"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "row.source", "row.n")
    right = info.select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sources", "totals", "v")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        sources, totals, v = (right[c][0].as_py() for c in ("sources", "totals", "v"))
        number = {s: i for i, s in enumerate(sources)}
        own, n = (left[c].combine_chunks() for c in ("source", "n"))
        names = own.flatten().dictionary_encode()
        place = np.array([number[s] for s in names.dictionary.to_pylist()], dtype=np.int64)
        source = place[names.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, dtype=np.int64)
        offsets = np.append(0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        sums = tree_differences(source, n.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets, np.array(totals, dtype=np.int64), v)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = pa.array(sources, pa.string())
        return pa.table({"lang": pa.array([right["lang"][0].as_py()] * len(a), pa.string()), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": sums[a, b]})

    keys = ["lang", "part"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_audit(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How sources of a language differ, and by which terms: (lang, source, part, item, value, rank).

    Terms are runs of letters and characters beyond ASCII in the whole text after A-Z are lower-cased; a language keeps those
    that stand in at least `least` of its documents. With V kept terms and N their occurrences, a group (a source of a
    language, or the language) gives a term p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)). part `pair`: item is each other
    source of the language, value the sum of |p - q| over all kept terms. part `term`: item is a kept term that the
    group has and whose p is above the language's q, value p - q, the `top` largest. rank counts from 1 by falling value, equal
    ones by the bytes of item.

    Null texts, languages and sources count as ''. Groups without terms take part; a language without kept terms gives
    pairs of value 0, one of a single source no pairs. Rows that repeat are documents each. Other columns are ignored;
    an empty table gives no rows.

    Tasks count terms for themselves before anything is shuffled; a language's rows are dealt to trees of bounded size.
    """
    counts = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    rows = by_source.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("row"), F.sum("df").alias("df"))
    rows = stored(rows.where((F.col("df") >= least) | (F.col("term") == "")).drop("df"), "audit-rows")
    # the empty term's row has all sources of the language
    sums = rows.select("lang", F.explode("row").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    groups = stored(sums, "audit-groups")
    size = rows.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("source", "total")))
    info = groups.groupBy("lang").agg(listed.alias("g"), F.sum("total").alias("lang_total")).join(size, "lang")
    info = stored(info.select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), "lang_total", "v"), "audit-info")
    kept = rows.where("term <> ''")
    pairs = _pair_sums(kept, info).withColumn("part", F.lit("pair"))

    each = kept.withColumn("lang_n", F.aggregate("row", F.lit(0).cast("long"), lambda s, e: s + e["n"])).select("lang", "term", "lang_n", F.explode("row").alias("e")).select("lang", "term", "lang_n", "e.*").where("n > 0")
    each = each.join(groups, ["lang", "source"]).join(info.select("lang", "lang_total", "v"), "lang")
    value = _share(F.col("n"), F.col("total"), F.col("v")) - _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    more = each.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0").withColumn("part", F.lit("term"))

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(w)) for rows in (pairs, more)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
