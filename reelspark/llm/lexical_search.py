"""Ranked lexical search over frequency-ordered trees of documents, by branch and bound.

A document is the vector of those of its terms that some item asks for, in order of document frequency, most
frequent first; documents with equal beginnings share a path of a trie. A node knows, of the documents below it, the largest
count of each term, the smallest length factor m and the smallest id. A score grows with counts and falls with m, so
these bound every score below a node; a search goes depth-first into the child with the highest bound and leaves out
what can't reach the k-th best so far.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import lean, stored
from reelspark.llm.terms import WITH_DIGITS, terms

#: Terms (with repeats over items) whose items are searched in one pass over the documents.
BLOCK_TERMS = 1 << 17
#: Entries of a tree; a task builds one after the other and carries its best documents on.
TREE_ENTRIES = 1 << 20
#: Documents of a leaf.
LEAF = 16


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): different terms of each item; rows that repeat an id are one item, rows without an id none."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms(t, WITH_DIGITS))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t.decode() for t in x] for x in found], pa.list_(pa.string()))], names=["item_id", "terms"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    one = rows.mapInArrow(lean(run), "item_id long, terms array<string>").withColumn("term", F.explode("terms"))
    return one.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def item_blocks(asked: DataFrame, most: int = BLOCK_TERMS) -> tuple[DataFrame, int]:
    """(items with their block, number of blocks): no block has over `most` terms, unless one item alone has."""
    n = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / most))
    while True:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
        full = dealt.groupBy("block").agg(F.sum(F.size("terms")).alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > most) & (F.col("n") > 1))
        if full.isEmpty():
            return dealt, n
        n *= 2


def restricted(docs: DataFrame, id_col: str, text_col: str, vocab: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each whole text: its number of terms, and those in `vocab` by their numbers, with counts."""

    def run(batches):
        for batch in batches:
            n, held, counts = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms(t, WITH_DIGITS)
                own = Counter(filter(vocab.__contains__, words))
                n.append(len(words))
                held.append([vocab[w] for w in own])
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n long, terms array<int>, counts array<long>")


class DocumentTree:
    """A path-compressed trie of documents whose terms are numbered by falling document frequency.

    `rows` are (doc_id, m, ranks ascending, counts). Nodes are numbered level by level, so that the children of
    one follow one another, and documents stand in the order of their paths. Maxima are kept as sorted keys
    (node * terms + rank), without an entry for what is not there.
    """

    def __init__(self, rows: list[tuple], n_terms: int):
        paths = [r[2].astype(">u4").tobytes() for r in rows]
        order = sorted(range(len(rows)), key=paths.__getitem__)
        rows, self.n_terms = [rows[i] for i in order], max(1, n_terms)
        self.ids, self.m = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
        size = np.array([len(r[2]) for r in rows], dtype=np.int64)
        rank, count = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (2, 3))
        self.doc_keys, self.doc_counts = np.repeat(np.arange(len(rows)), size) * self.n_terms + rank, count
        self._split([r[2] for r in rows])
        self._bound()

    def _split(self, paths: list[np.ndarray]) -> None:
        low, high, first, after, level = [0], [len(paths)], [], [], [0]
        at = 0
        while at < len(low):
            if at == level[-1]:
                level.append(len(low))
            a, b = low[at], high[at]
            first.append(len(low))
            if b - a > LEAF:
                x, y = paths[a], paths[b - 1]
                n = min(len(x), len(y))
                apart = np.flatnonzero(x[:n] != y[:n])
                depth = int(apart[0]) if len(apart) else n
                if depth < len(y):  # else all are equal, and one leaf
                    head = np.array([p[depth] if len(p) > depth else -1 for p in paths[a:b]], dtype=np.int64)
                    cuts = [a, *(np.flatnonzero(head[1:] != head[:-1]) + a + 1).tolist(), b]
                    low += cuts[:-1]
                    high += cuts[1:]
            after.append(len(low))
            at += 1
        self.low, self.high, self.first, self.after = (np.array(v, dtype=np.int64) for v in (low, high, first, after))
        self.levels = [*level, len(low)]

    def _bound(self) -> None:
        self.least_m, self.least_id = (np.minimum.reduceat(np.append(v, np.iinfo(np.int64).max), np.stack((self.low, self.high), axis=1).ravel())[::2] for v in (self.m, self.ids))
        owner, keys, counts, done = self.doc_keys // self.n_terms, [], [], (np.zeros(0, dtype=np.int64),) * 3
        for a, b in reversed(list(zip(self.levels[:-1], self.levels[1:], strict=True))):
            if a == b:
                continue
            # the level's leaves get what their documents have, other nodes what their children have
            leaf = np.arange(a, b)[self.first[a:b] == self.after[a:b]]
            of = np.full(len(self.ids), -1)
            for n in leaf.tolist():
                of[self.low[n] : self.high[n]] = n
            own = of[owner] >= 0
            parent = np.repeat(np.arange(a, b), (self.after - self.first)[a:b])
            from_child = parent[done[0] - self.first[a:b].min(initial=b)] if len(done[0]) else done[0]
            node, rank, count = (np.concatenate(x) for x in ((of[owner[own]], from_child), (self.doc_keys[own] % self.n_terms, done[1]), (self.doc_counts[own], done[2])))
            key = node * self.n_terms + rank
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            key, count = key[begin], np.maximum.reduceat(count, begin) if len(begin) else count
            keys.append(key)
            counts.append(count)
            done = key // self.n_terms, key % self.n_terms, count
        self.keys, self.counts = (np.concatenate(x[::-1]) for x in (keys, counts))

    def _scores(self, keys: np.ndarray, counts: np.ndarray, rows: np.ndarray, m: np.ndarray, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(rows), dtype=np.int64)
        want = rows[:, None] * self.n_terms + ranks[None, :]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        tf = np.where(keys[at] == want, counts[at], 0)
        return (weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None]))).sum(axis=1)

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Bring `best`, a heap of (score, -doc_id) with the worst first, up to date with this tree's documents."""
        beaten = lambda score, least: score <= 0 or len(best) == k and (score, -least) < best[0]
        stack = [(int(self._scores(self.keys, self.counts, np.zeros(1, dtype=np.int64), self.least_m[:1], ranks, weights)[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if beaten(bound, int(self.least_id[node])):
                continue
            if self.first[node] < self.after[node]:
                below = np.arange(self.first[node], self.after[node])
                bounds = self._scores(self.keys, self.counts, below, self.least_m[below], ranks, weights)
                stack += [(int(bounds[i]), int(below[i])) for i in np.argsort(bounds, kind="stable") if bounds[i] > 0]
                continue
            below = np.arange(self.low[node], self.high[node])
            scores = self._scores(self.doc_keys, self.doc_counts, below, self.m[below], ranks, weights)
            good = scores > 0 if len(best) < k else scores >= max(1, best[0][0])
            for score, doc in zip(scores[good].tolist(), self.ids[below[good]].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, -doc))
                elif (score, -doc) > best[0]:
                    heapq.heapreplace(best, (score, -doc))


def _trees(batches: Iterator, rank_of: np.ndarray, n_docs: int, n_all: int) -> Iterator[DocumentTree]:
    rows, entries = [], 0
    for batch in batches:
        ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        of, tf = batch.column(2), batch.column(3)
        at, ranks, counts = of.offsets.to_numpy(), rank_of[of.values.to_numpy(zero_copy_only=False)], tf.values.to_numpy(zero_copy_only=False)
        m = 100 - 50 + (50 * n.astype(np.int64) * n_docs) // max(1, n_all)
        for i in range(len(ids)):
            part = slice(at[i], at[i + 1])
            order = np.argsort(ranks[part], kind="stable")
            rows.append((int(ids[i]), int(m[i]), ranks[part][order], counts[part][order]))
            entries += len(order)
            if entries >= TREE_ENTRIES:
                yield DocumentTree(rows, len(rank_of))
                rows, entries = [], 0
    if rows:
        yield DocumentTree(rows, len(rank_of))


def _block(docs: DataFrame, items: list, id_col: str, text_col: str, k: int) -> DataFrame:
    """(item_id, doc_id, score): a superset of the k best documents of each of `items`, at most k from each task."""
    vocab = {t: i for i, t in enumerate(sorted({t.encode() for r in items for t in r["terms"]}))}
    vectors = stored(restricted(docs, id_col, text_col, vocab), "lexical-vectors")
    whole = vectors.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("all")).first()
    n_docs, n_all = whole["docs"], whole["all"] or 0
    df = np.zeros(len(vocab), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each asked term at most
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    rank_of = np.empty(len(vocab), dtype=np.int64)
    rank_of[np.argsort(-df, kind="stable")] = np.arange(len(vocab))
    asked = []
    for r in items:
        own = np.array([vocab[t.encode()] for t in r["terms"]], dtype=np.int64)
        own = own[(df[own] > 0) & (weight[own] > 0)]
        asked.append((r["item_id"], rank_of[own], weight[own]))

    def run(batches):
        best: list[list] = [[] for _ in asked]
        for tree in _trees(batches, rank_of, n_docs, n_all):
            for heap, (_, ranks, weights) in zip(best, asked, strict=True):
                if len(ranks):
                    tree.search(ranks, weights, heap, k)
        found = [(item, -d, s) for heap, (item, _, _) in zip(best, asked, strict=True) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

    held = vectors.where("doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "counts")
    return held.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """The k documents of `docs` that score highest for each of `items`: (item_id, rank, doc_id, score).

    Terms are runs of digits, letters and all characters beyond ASCII in the whole text after A-Z are lower-cased. With N
    documents that have terms, L terms in all, n and tf of a document and df of a term, w = floor(1000 * ln((2 * N + 2) /
    (2 * df + 1))), m = 50 + (50 * n * N) div L, and a score is the sum of w * ((10^9 * tf) div (1000 * tf + 20 * m)) over
    the item's different terms. Only scores above 0 count; equal ones go by id.

    Null and empty texts have no terms and are never found. Documents without an id count in N, L and df and are not found
    either; rows that repeat an id are documents each. Rows of `items` that repeat an id are one item; those without
    an id, and items without terms, give no rows. Other columns are ignored; an empty table gives no rows.

    Items are searched in blocks of a bounded number of terms, which go to every task; each block takes one pass over
    the texts. A task holds one tree of bounded size at a time and gives at most k documents for each item, whose
    best are then ranked.
    """
    asked, n = item_blocks(stored(item_terms(items, item_col, item_text_col), "lexical-items"), block_terms)
    asked = stored(asked, "lexical-blocks")
    found = None
    for b in range(n):
        rows = asked.where(F.col("block") == b).select("item_id", "terms").collect()
        if rows:
            part = stored(_block(docs, rows, id_col, text_col, k), "lexical-found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
