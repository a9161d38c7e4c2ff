"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of vectors serves as reference points (pivots). Each vector is described by its nearest
pivots in order; an inverted list holds, for a pivot, the vectors that have it among their nearest.
Within a list shared pivots are counted first, and only vectors that share enough of them are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import stored
from reelspark.llm.components import connected_components

#: Rows of one block of an inverted list; a longer list is worked on as pairs of blocks.
BLOCK = 1024
#: Pivots at least and at most; in between, four times the square root of the number of different vectors.
PIVOTS = (128, 2048)
#: From so many different vectors on, lists are kept for pairs of pivots: two million instead of 2048. The candidates are the same.
PAIRS_FROM = (PIVOTS[1] // 4) ** 2


def usable(vec: str = "embedding"):
    """Not null, not empty, no null or non-finite components, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def pivots_for(n: int) -> int:
    """How many pivots an index of n vectors gets: lists grow with the square root of n only, up to the largest number of pivots."""
    return int(min(PIVOTS[1], max(PIVOTS[0], 4 * n**0.5)))


def fit_pivots(classes: DataFrame, n_pivots: int, sample: int = 8, apart: float = 0.9) -> dict[int, np.ndarray]:
    """Unit pivots for each length of vectors, from a bounded sample: the `sample * n_pivots` distinct vectors with the smallest hashes.

    Of the sample's vectors of one length one after the other is taken, up to `n_pivots`, unless its cosine with a pivot is
    `apart` or more: a large group of near copies gives few pivots, whose places in a vector's order noise can't change.
    A length with few vectors in the sample of a larger table gets random pivots as well, up to `n_pivots`.
    """
    got, by = classes.select("vec").where(F.size("vec") > 0).orderBy(F.xxhash64("vec"), "vec").limit(sample * n_pivots).collect(), {}
    for r in got:
        by.setdefault(len(r["vec"]), []).append(r["vec"])
    out = {}
    for width, rows in by.items():
        pivots, n = np.zeros((n_pivots, width)), 0
        for v in _unit(np.array(rows, dtype=np.float64)):
            if n < n_pivots and (pivots[:n] @ v < apart).all():
                pivots[n], n = v, n + 1
        few = len(got) == sample * n_pivots and len(rows) < 2 * n_pivots
        out[width] = np.concatenate((pivots[:n], random_pivots(width, n_pivots - n))) if few else pivots[:n]
    return out


def random_pivots(width: int, n: int) -> np.ndarray:
    """Unit pivots for a length of which no sample tells anything; the same in every task."""
    return _unit(np.random.default_rng(width).normal(size=(n, width))) if n else np.zeros((0, width))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest pivots of each unit vector, in order."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int32)


def lists_of(near: np.ndarray, n_pivots: int, level: int) -> np.ndarray:
    """The inverted lists of each vector: of its nearest pivots at level 1, of their pairs at level 2."""
    if level == 1:
        return near.astype(np.int64)
    near = np.sort(near, axis=1).astype(np.int64)
    a, b = np.triu_indices(near.shape[1], 1)
    return near[:, a] * n_pivots + near[:, b]


def candidates(near: np.ndarray, n_pivots: int, need: int, pivot: int = 0, second: int | None = None) -> np.ndarray:
    """Which vectors share at least `need` of their nearest pivots, of which `pivot` is the first by number (0: any may be), and `second` the next."""
    has = np.zeros((len(near), n_pivots), dtype=np.float32)
    has[np.arange(len(near))[:, None], near] = 1
    low = has[:, : pivot if second is None else second].copy()
    if second is not None:
        low[:, pivot] = 0
    return (has @ has.T >= need) & (low @ low.T == 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge components get lost in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row reachable."""
    low = np.arange(len(linked))
    while True:
        new = np.where(linked, low, len(low)).min(axis=1, initial=len(low))
        new = np.minimum(low, new)
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def embedding_groups(
    vectors: DataFrame,
    threshold: float = 0.93,
    n_pivots: int | None = None,
    nearest: int = 8,
    shared: int = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null, by cosine in double precision; pairs
    with cosine >= `threshold` are links. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, as do those without an id; vectors of other lengths only link among
    their like. component_id is the smallest id reachable by links. Ids should be unique.

    Equal vectors of a label are one class, counted with its size, so a third of all rows being one
    vector makes one index entry. A class stands in the lists of its `nearest` pivots; two classes are
    candidates if they share at least `shared` pivots, which is counted before anything else, and are compared in
    the list of the first pivot they share (in large tables: of the first pair). A list longer than a block is dealt as pairs of blocks, so no task grows with it. In each
    block pair links are counted and only a spanning forest of them leaves the task. A pair whose nearest
    pivots differ too much is not found: that is the index's recall.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vec"))
    # -0.0 and 0.0 are one number here
    ok = ok.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    classes = stored(ok.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "embed-classes")
    n = classes.count()
    n_pivots = n_pivots or pivots_for(n)
    pivots = fit_pivots(classes, n_pivots)
    # sharing two pivots or more is sharing a pair
    level = 2 if n >= PAIRS_FROM and shared >= 2 else 1

    def describe(batches):
        for pdf in batches:
            width = pdf["vec"].map(len)
            for n in sorted(width.unique()):
                part = pdf[width == n]
                x = _unit(np.stack(part["vec"].to_numpy()).astype(np.float64))
                own = pivots[n] if n in pivots else random_pivots(int(n), n_pivots)
                near = nearest_pivots(x, own, nearest)
                deep = level if near.shape[1] >= 2 else 1
                yield pd.DataFrame({"label": part["label"], "dims": int(n), "rep": part["rep"], "copies": part["copies"], "near": list(near), "lists": list(lists_of(near, n_pivots, deep)), "unit": list(x)})

    kind = dict(rows.dtypes)["label"]
    described = classes.mapInPandas(describe, f"label {kind}, dims int, rep long, copies long, near array<int>, lists array<long>, unit array<double>")
    described = stored(described, "embed-described")
    sizes = described.select("label", "dims", F.explode("lists").alias("pivot")).groupBy("label", "dims", "pivot").count()
    sizes = stored(sizes.where("count > 1").select("label", "dims", "pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "embed-sizes")
    posted = described.withColumn("pivot", F.explode("lists")).drop("lists").join(sizes, ["label", "dims", "pivot"])
    posted = posted.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = posted.withColumn("other", other).select(
        "label", "dims", "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "near", "unit"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        n, p = len(pdf), int(pdf["pivot"].iloc[0])
        x = np.stack(pdf["unit"].to_numpy())
        rep, copies, block = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        near = np.stack(pdf["near"].to_numpy())
        own = divmod(p, n_pivots) if level == 2 and near.shape[1] >= 2 else (p, None)
        linked = candidates(near, n_pivots, min(shared, near.shape[1]), *own)
        linked[np.arange(n), np.arange(n)] = False
        if pdf["low"].iloc[0] != pdf["high"].iloc[0]:
            linked &= block[:, None] != block[None, :]  # pairs within one block belong to that block's own group
        if linked.mean() > 0.1:
            linked &= x @ x.T >= threshold
        else:
            a, b = np.nonzero(np.triu(linked))
            ok = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 8192]], x[b[i : i + 8192]]) >= threshold for i in range(0, len(a), 8192)] or [np.zeros(0, dtype=bool)])
            linked[:] = False
            linked[a[ok], b[ok]] = linked[b[ok], a[ok]] = True
        links, root = linked @ copies, rep[_roots(linked)]
        keep = links > 0
        return pd.DataFrame({"rep": rep[keep], "links": links[keep], "root": root[keep]})

    found = stored(dealt.groupBy("label", "dims", "pivot", "low", "high").applyInPandas(compare, "rep long, links long, root long"), "embed-links")
    edges = found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    whole = stored(connected_components(edges, "embed"), "embed-whole")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))

    states = classes.join(counts, "rep", "left").join(whole.select(F.col("id").alias("rep"), "component"), "rep", "left")
    states = states.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    states = stored(states, "embed-states")
    out = ok.join(states, ["label", "vec"], "left").select("vec_id", "links", F.coalesce("component", "vec_id").alias("component"))
    # what links with nothing has no part in the join, where it would be one key
    can = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vec"), F.lit(False))
    out = out.unionByName(rows.where(~can).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
