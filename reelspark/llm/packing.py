"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import lean, stored
from reelspark.llm.encode import encoder

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"

#: Words whose ids a worker remembers, unless told otherwise: workers outlive their tasks, and other stages run beside what they remember.
CACHE_WORDS = 500_000


class OpenBins:
    """Open bins by remaining room, under a segment tree over the rooms 0..size.

    Node i is set if any bin below it is open; the tightest bin for a length is the leftmost set leaf at
    or after it, found by climbing until a right neighbour is set and going down again: O(log size).
    """

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, label: int) -> None:
        self.bins[room].append(label)
        i = room + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, label) of the tightest open bin with room for `length`, which is then no longer open."""
        i = length + self.leaves
        while not self.any[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        label = self.bins[room].pop()
        if not self.bins[room]:
            self.any[i] = 0
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = 0
        return room, label


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first (ties in the given order), each into the tightest open bin."""
    bins, offsets, opened, rooms = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, OpenBins(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room, label = rooms.take(n) or (size, opened)
        opened += label == opened
        bins[i], offsets[i] = label, size - room
        if room > n:
            rooms.put(room - n, label)
    return bins, offsets


def pieces(docs: DataFrame, path: str, kind: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Each document's ids (null text: empty) and `end_id`, cut only where longer than `size`: one row per piece."""

    def run(batches):
        enc = encoder(path, kind, cache_words)
        for batch in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
            out: list[tuple] = []
            docs, rows, texts = (c.to_pylist() for c in batch.columns)
            for doc, row, x in zip(docs, rows, enc.encode_all([t or "" for t in texts]), strict=True):
                ids = np.append(x, np.uint32(end_id)).astype("<u4")
                out += [(doc, row, k, a, len(p := ids[a : a + size]), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), size))]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), PIECES)


def packed(cut: DataFrame, size: int, group_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to `size`.

    The rows (lengths and keys only, no ids) are dealt by a hash of all their columns into groups of
    about `group_rows`, each with the mix of lengths of the whole, so no task grows with the input. Then the rows
    of all sequences with more than 1/64 of room are taken out and packed anew, in fewer groups, and so on while
    that at least halves the groups: what groups leave over meets in the end in one group.
    """
    out, turn, groups = [], 0, max(1, -(-cut.count() // group_rows))
    while True:
        got = stored(_packed_once(cut, size, groups, turn), f"packed-{turn}")
        left = got.where("open")
        fewer = max(1, -(-left.count() // group_rows))
        if groups == 1 or 2 * fewer > groups:
            out.append(got.drop("open"))
            return functools.reduce(DataFrame.unionByName, out)
        out.append(got.where("not open").drop("open"))
        cut, turn, groups = left.drop("open", "sequence_id", "offset"), turn + 1, fewer


def _packed_once(cut: DataFrame, size: int, groups: int, turn: int) -> DataFrame:
    """Each group packed by itself; open tells whether a row's sequence has more than 1/64 of room."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got).sort_by([(c, "ascending") for c in ("length", "doc_id", "row", "piece")])
        lengths, part = got["length"].to_numpy(), got["part"].to_numpy().astype(np.int64)
        bins, offsets = best_fit(lengths, size)
        room = size - np.bincount(bins, weights=lengths)
        # numbers of rounds, groups and sequences side by side
        number = (turn << 56) + (part << 24) + bins
        got = got.drop_columns(["part"])
        for name, values in (("sequence_id", number), ("offset", offsets), ("open", room[bins] * 64 > size)):
            got = got.append_column(name, pa.array(values))
        yield from got.to_batches(max_chunksize=10_000)

    dealt = cut.repartition(groups, F.xxhash64("doc_id", "row", "piece", F.lit(turn))).withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(lean(run), PIECES + ", sequence_id long, offset long, open boolean")


def pack_documents(
    docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 50_000, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """Pack documents into sequences of at most `size` tokens: one row per piece of a document.

    Returns doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers), sequence_id and offset; the offsets of a sequence have no
    gaps and start at 0. Null and empty texts are one piece of the end id alone. Rows that repeat an id
    are packed one by one; a null id stays null. Other columns are ignored; no rows give no rows.
    """
    cut = stored(pieces(docs, path, kind, end_id, size, id_col, text_col, cache_words), "pack-pieces")
    return packed(cut, size, group_rows).drop("row")
