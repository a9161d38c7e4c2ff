"""Exact search for the largest inner products by an M-tree.

With every vector v lifted to (v, sqrt(M^2 - |v|^2)), where M is the largest norm, and a query q to (q, 0), the squared distance is
|q|^2 + M^2 - 2 q.v: the largest inner products are the nearest neighbours, and a metric tree finds them. The
uppermost level are routing vectors from a bounded sample; each vector belongs to the nearest of its length. A region is
cut into blocks of bounded size, and each block is a tree of pages, stored as rows: a page has a routing
vector, a covering radius and its distance from the routing vector above, and a leaf the distances of its vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import lean, stored

#: Routing vectors at most, and vectors for one of them; the sample they come from has so many times as many vectors.
ROUTES, PER_ROUTE, SAMPLE = 1024, 4096, 4
#: Vectors of a block at most, on average, and of a page; queries that are set against a block at once.
BLOCK, PAGE, QUERIES = 8192, 512, 1024
#: Regions in which a query is searched first, to know what its best scores are worth.
FIRST = 3
#: Squared norms from here on can't be multiplied in 64 bits; sums below the second are exact in doubles in whatever order.
LARGEST, EXACT = 2.0**62, 2.0**53


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of every component; only vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    floors = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    norm = F.aggregate(F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")), F.lit(0.0), lambda s, c: s + c * c)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), floors.alias("vec"), norm.alias("norm")).where(F.col("norm") < LARGEST).drop("norm")


def numbers(x: np.ndarray, most: float) -> np.ndarray:
    """Whole numbers of vectors with squared norms up to `most` in a form whose inner products are exact: doubles, where those hold every sum."""
    return x.astype(np.float64 if most < EXACT else np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def distances(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Between lifted vectors, rows of `x` by rows of `y`; `most` is the largest squared norm."""
    nx, ny = norms(x), norms(y)
    lift = np.sqrt(np.maximum(most - nx, 0))[:, None] - np.sqrt(np.maximum(most - ny, 0))[None, :]
    return np.sqrt(np.maximum(nx[:, None] + ny[None, :] - 2.0 * (x.astype(np.float64) @ y.astype(np.float64).T) + lift**2, 0))


def from_query(dot: np.ndarray, q2: float, most: float) -> np.ndarray:
    """Distance of a query with squared norm `q2` from lifted vectors, by their inner products."""
    return np.sqrt(np.maximum(q2 + most - 2.0 * dot, 0))


def reach_of(score: int, q2: float, most: float) -> float:
    """The largest distance that a lifted vector with this inner product or more can have; rounding is allowed for."""
    whole = q2 + most
    return math.sqrt(max(whole - 2.0 * score + 2e-9 * whole, 0.0)) + 1e-6 * math.sqrt(whole)


def pages(x: np.ndarray, most: float) -> Iterator[dict]:
    """The pages of one block, parents before children.

    A page of more than PAGE vectors is split around some of them, each vector going to the nearest.
    """
    rng, todo, number = np.random.default_rng(0), [(np.arange(len(x)), -1, 0, 0.0)], 0
    while todo:
        at, parent, route, up = todo.pop()
        d = distances(x[at], x[route][None, :], most)[:, 0]
        page = {"page": number, "parent": parent, "center": x[route], "radius": float(d.max()), "up": up, "at": None, "apart": None}
        if len(at) > PAGE:
            chosen = rng.choice(len(at), min(PAGE, -(-2 * len(at) // PAGE)), replace=False)
            own = distances(x[at], x[at[chosen]], most).argmin(axis=1)
            parts = [(at[own == i], number, int(at[c]), float(d[c])) for i, c in enumerate(chosen.tolist())]
            todo += [p for p in parts if len(p[0])]
        else:
            page |= {"at": at, "apart": d}
        yield page
        number += 1


class Tree:
    """The pages of a block, in memory."""

    def __init__(self, pdf: pd.DataFrame, most: float):
        pdf, self.most = pdf.sort_values("page", kind="stable"), most
        whole = lambda b: np.frombuffer(b, dtype=np.int64)
        self.center = numbers(np.stack([whole(b) for b in pdf["center"]]), most)
        self.radius, self.up = (pdf[c].to_numpy() for c in ("radius", "up"))
        dims = self.center.shape[1]
        leaves = zip(pdf["leasts"], pdf["nodes"], pdf["rows"], pdf["apart"], strict=True)
        self.leaves = [(whole(i), whole(n), numbers(whole(r).reshape(len(whole(i)), dims), most), np.frombuffer(d, dtype=np.float64)) if i is not None else None for i, n, r, d in leaves]
        parent = pdf["parent"].to_numpy()
        order = np.argsort(parent, kind="stable")
        cuts = np.searchsorted(parent[order], np.arange(len(parent) + 1))
        self.below = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.computed = 0

    def search(self, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int, int]]:
        """The k best (score, -smallest id, node), as a heap; those below `floor` aren't needed. Best first: the nearest page is next."""
        q2, most, best, queue = float(norms(q[None, :])[0]), self.most, [], []
        q, reach, worst = numbers(q, most), math.inf, None
        if floor is not None:
            reach, worst = reach_of(floor, q2, most), floor
        to = from_query(self.center[:1] @ q, q2, most)
        heapq.heappush(queue, (float(to[0] - self.radius[0]), 0, float(to[0])))
        self.computed += 1
        while queue:
            nearest, page, d = heapq.heappop(queue)
            if nearest > reach:
                break
            if self.leaves[page] is None:
                below = self.below[page]
                # stored distances first: what they rule out needs no product
                below = below[np.abs(d - self.up[below]) - self.radius[below] <= reach]
                to = from_query(self.center[below] @ q, q2, most)
                self.computed += len(below)
                for low, p, x in zip((to - self.radius[below]).tolist(), below.tolist(), to.tolist(), strict=True):
                    if low <= reach:
                        heapq.heappush(queue, (low, p, x))
                continue
            leasts, nodes, rows, apart = self.leaves[page]
            if worst is not None:
                near = np.flatnonzero(np.abs(d - apart) <= reach)
                leasts, nodes, rows = leasts[near], nodes[near], rows[near]
            scores = rows @ q
            self.computed += len(scores)
            good = np.flatnonzero(scores >= worst) if worst is not None else np.arange(len(scores))
            for found in zip(map(int, scores[good].tolist()), (-leasts[good]).tolist(), nodes[good].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k and (worst is None or best[0][0] > worst):
                worst = best[0][0]
                reach = reach_of(worst, q2, most)
        return best


def _matrix(vecs: pa.Array, dims: int) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vecs), dims)


def _routes(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """At most n routing vectors (one more for each length) from a bounded sample: those of the smallest hashes that lie far from one another."""
    by: dict[int, list] = {}
    for r in classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE * n).collect():
        by.setdefault(len(r["vec"]), []).append(r["vec"])
    out = {}
    for dims, rows in by.items():
        x = np.array(rows, dtype=np.int64).reshape(len(rows), dims)
        most, near, chosen = float(norms(x).max()), np.full(len(x), np.inf), [0]
        while len(chosen) < len(rows) // SAMPLE:
            near = np.minimum(near, distances(x, x[chosen[-1]][None, :], most)[:, 0])
            chosen.append(int(near.argmax()))
        out[dims] = x[chosen]
    return out


def _placed(classes: DataFrame, routes: dict[int, np.ndarray], most: float) -> DataFrame:
    """`classes` with dims, region (the nearest routing vector's number; 0 where a length has none) and apart (its distance)."""

    def run(batches):
        for batch in batches:
            vecs = batch.column(1)
            width = vecs.value_lengths().to_numpy(zero_copy_only=False)
            region, apart = np.zeros(len(width), dtype=np.int32), np.zeros(len(width))
            for dims in set(np.unique(width).tolist()) & routes.keys():
                at = np.flatnonzero(width == dims)
                for part in (at[i : i + 4096] for i in range(0, len(at), 4096)):
                    d = distances(_matrix(vecs.take(pa.array(part)), dims), routes[dims], most)
                    region[part], apart[part] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width, pa.int32()), pa.array(region), pa.array(apart)], names=[*batch.schema.names, "dims", "region", "apart"])

    return classes.mapInArrow(lean(run), "node long, vec array<long>, least long, asked boolean, dims int, region int, apart double")


def _pages(placed: DataFrame, most: float) -> DataFrame:
    """The pages of all blocks, one row each; a leaf has its vectors with their nodes and smallest ids."""

    def build(t: pa.Table) -> pa.Table:
        dims = t["dims"][0].as_py()
        node, least = (t[c].to_numpy() for c in ("node", "least"))
        x, out = _matrix(t["vec"].combine_chunks(), dims), []
        for p in pages(x, most):
            at, leaf = p["at"], p["at"] is not None
            held = [x[at].tobytes(), least[at].tobytes(), node[at].tobytes(), p["apart"].tobytes()] if leaf else [None] * 4
            out.append((p["page"], p["parent"], p["center"].tobytes(), p["radius"], p["up"], *held))
        same = [pa.array([t[c][0].as_py()] * len(out), pa.int32()) for c in ("dims", "region", "block")]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        names = ["page", "parent", "center", "radius", "up", "rows", "leasts", "nodes", "apart", "dims", "region", "block"]
        return pa.Table.from_arrays([*[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], *same], names=names)

    schema = "page int, parent int, center binary, radius double, up double, rows binary, leasts binary, nodes binary, apart binary, dims int, region int, block int"
    return placed.select("node", "vec", "least", "dims", "region", "block").groupBy("dims", "region", "block").applyInArrow(build, schema)


def _searched(queries: DataFrame, tree: DataFrame, most: float, k: int, name: str) -> DataFrame:
    """(asker, node, least, score): the k best of each query in the blocks it is dealt to; `queries` is stored and has asker, vec, floor and the block.

    A block's queries are cut into slices of about QUERIES, by counts; its pages go to each slice.
    """
    block = ["dims", "region", "block"]
    slices = queries.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("slices"))
    slices = stored(slices, f"{name}-slices")
    cut = queries.join(slices, block).withColumn("slice", F.pmod(F.xxhash64("asker"), F.col("slices")).cast("int"))
    pages_of = tree.join(slices, block).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    keys = [*block, "slice"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            t = Tree(right, most)
            for asker, vec, floor in zip(left["asker"], left["vec"], left["floor"], strict=True):
                out += [(asker, node, -least, score) for score, least, node in t.search(np.asarray(vec, dtype=np.int64), k, None if pd.isna(floor) else int(floor))]
        return pd.DataFrame(out, columns=["asker", "node", "least", "score"]).astype("int64")

    held = cut.select("asker", "vec", F.col("floor").cast("string").alias("floor"), *[F.col(c).alias(c) for c in keys])
    return held.groupBy(*keys).cogroup(pages_of.drop("slices").groupBy(*keys)).applyInPandas(run, "asker long, node long, least long, score long")


def _dealt(queries: DataFrame, regions: DataFrame, routes: dict[int, np.ndarray], most: float, first: int | None) -> DataFrame:
    """`queries` (asker, vec, floor, dims) with the blocks in which they are searched.

    With `first`: of each of the so many regions whose routing vectors are nearest one block, by a hash of the query. Without: the other
    blocks of all regions that may hold scores of `floor` or more.
    """
    radius = {d: np.zeros(len(r)) for d, r in routes.items()}
    for r in regions.where(F.col("dims").isin(list(routes))).collect():  # one for each routing vector at most
        radius[r["dims"]][r["region"]] = r["radius"]
    routing = {d: numbers(r, most) for d, r in routes.items()}

    def run(batches):
        for batch in batches:
            vecs, dims, floors = batch.column(1), batch.column(3).to_pylist(), batch.column(2).to_pylist()
            near, to = [], []
            for i, (d, floor) in enumerate(zip(dims, floors, strict=True)):
                if d not in routing:
                    near.append([0])
                    to.append([0])
                    continue
                q = _matrix(vecs.slice(i, 1), d)[0]
                q2 = float(norms(q[None, :])[0])
                apart = from_query(routing[d] @ numbers(q, most), q2, most)
                near.append(np.argsort(apart, kind="stable")[:FIRST].tolist())
                to.append((np.flatnonzero(apart - radius[d] <= reach_of(floor, q2, most)) if floor is not None else np.arange(len(apart))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.list_(pa.int32())) for x in (near, to)]], names=[*batch.schema.names, "near", "to"])

    rows = queries.select("asker", "vec", "floor", "dims").mapInArrow(lean(run), "asker long, vec array<long>, floor long, dims int, near array<int>, to array<int>")
    rows = rows.select("asker", "vec", "floor", "dims", "near", F.explode("near" if first else "to").alias("region"))
    rows = rows.join(regions.select("dims", "region", "blocks"), ["dims", "region"])
    own = F.pmod(F.xxhash64("asker"), F.col("blocks")).cast("int")  # as the class itself is dealt
    if first:
        return rows.withColumn("block", own).drop("near", "blocks")
    rows = rows.withColumns({"own": own, "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    return rows.where((F.col("block") != F.col("own")) | ~F.array_contains("near", F.col("region"))).drop("near", "own", "blocks")


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", n_routes: int | None = None) -> DataFrame:
    """The k vectors with the largest inner products for each query: (query_id, rank, vec_id, score).

    Vectors are made whole numbers by floor(scale * x). Queries are the rows whose id is divisible by `every`; candidates
    are all rows but the query's own, of the same number of components. Equal scores go by id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id and vectors whose squared
    length, as whole numbers, has no place in 62 bits. Rows that repeat an id and its vector count once; different
    vectors under one id are rows and queries each. Empty vectors meet each other with score 0. Other columns
    are ignored; an empty table gives no rows.

    Equal vectors are one class, of which the k + 1 smallest ids are kept: no others can be among a query's best. A
    class that is asked for is first searched in one block each of the regions nearest to it; its worst score then rules out whole
    regions by their covering radius, and only what is left is searched, in blocks of bounded size.
    """
    spark = vectors.sparkSession
    rows = stored(scaled(vectors, id_col, vec_col, scale).distinct(), "topk-rows")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0)
    classes = classes.join(asked.select("vec").distinct().withColumn("asked", F.lit(True)), "vec", "left")
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "vec", "ids", F.get("ids", F.lit(0)).alias("least"), F.coalesce("asked", F.lit(False)).alias("asked")), "topk-classes")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    seen = classes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.count_if("asked").alias("asked")).first()
    if not seen["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most, routes = float(seen["most"]), _routes(classes, n_routes or min(ROUTES, max(1, seen["n"] // PER_ROUTE)))

    placed = stored(_placed(classes.drop("ids"), routes, most), "topk-placed")
    regions = placed.groupBy("dims", "region").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"))
    regions = stored(regions.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "topk-regions")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.join(regions.select("dims", "region", "blocks"), ["dims", "region"]).withColumn("block", block)
    placed = stored(placed, "topk-blocks")
    tree = stored(_pages(placed, most), "topk-pages")

    queries = placed.where("asked").select(F.col("node").alias("asker"), "vec", "dims")
    near = stored(_dealt(queries.withColumn("floor", F.lit(None).cast("long")), regions, routes, most, FIRST), "topk-near")
    first = stored(_searched(near, tree, most, k + 1, "topk-near"), "topk-first")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "least", "node")
    first = first.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    first = stored(first, "topk-first-best")
    worst = first.groupBy("asker").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
    away = _dealt(queries.join(worst, "asker", "left"), regions, routes, most, None)
    rest = stored(_searched(stored(away, "topk-away"), tree, most, k + 1, "topk-away"), "topk-rest")

    found = first.unionByName(rest).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    by_class = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "node")
    found = found.select("asker", "node", "score").join(classes.select("node", F.explode("ids").alias("vec_id")), "node")
    found = found.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1)
    found = found.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("nth", "node", "vec_id", "score"))).alias("found"))
    named = asked.withColumnRenamed("vec_id", "query_id").join(classes.where("asked").select("vec", F.col("node").alias("asker")), "vec").select("query_id", "asker")
    others = F.slice(F.filter("found", lambda f: (f["node"] != F.col("asker")) | (f["vec_id"] != F.col("query_id"))), 1, k)
    out = named.join(found, "asker").select("query_id", F.posexplode(others).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
