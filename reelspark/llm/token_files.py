"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank (0: the commonest over all documents) and a rank takes 1 to 4 bytes, low
byte first. The sizes less one stand apart, two bits each, four to a control byte. A page holds whole
documents in ascending order of their ids (those without one first): header, document ids, token counts, control bytes, data
bytes. Pages are rows of Parquet files, so that they are written and read through Spark on any store.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import lean, shared_dir, text_key
from reelspark.llm.encode import encoder

HEADER = struct.Struct("<4sIIQ")
MAGIC = b"FRV2"
#: Bytes of each of the four values under a control byte.
SIZES = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)

#: Words whose ids a worker remembers: some 200 bytes each.
CACHE_WORDS = 1_500_000


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    most = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    low = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    for k in range(1, most):
        low[: len(v)] += v >= 1 << (8 * k)
    control = (low.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[:, :most][np.arange(most, dtype=np.uint8) <= low[: len(v), None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` values of `code`: control bytes look their four sizes up in a table, data bytes are gathered by offset."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    x = np.frombuffer(data, np.uint8)
    out = x[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        has = np.flatnonzero(size > k)
        out[has] |= x[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def page(docs: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """`docs` in order, those without an id first."""
    control, data = code(ranks)
    nulls = sum(d is None for d in docs)
    return HEADER.pack(MAGIC, len(docs), nulls, len(ranks)) + np.array(docs[nulls:], dtype="<i8").tobytes() + counts.astype("<u4").tobytes() + control + data


def open_page(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, token counts, ranks) of a page; raises on anything else."""
    magic, n, nulls, values = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token page")
    at = HEADER.size
    docs, counts = np.frombuffer(blob, "<i8", n - nulls, at), np.frombuffer(blob, "<u4", n, at + 8 * (n - nulls))
    at += 8 * (n - nulls) + 4 * n
    end = at + -(-values // 4)
    return [None] * nulls + docs.tolist(), counts, decode(blob[at:end], blob[end:], values)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of documents one after the other, each with `end_id` at its end, and where each ends."""
    ends = ends + np.arange(1, len(ends) + 1)
    own = np.ones(len(ids) + len(ends), dtype=bool)
    own[ends - 1] = False
    out = np.full(len(own), end_id, dtype=np.uint32)
    out[own] = ids
    return out, ends


def id_bytes(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each document's ids as bytes: two of each id, or four where one of the document's is larger."""
    if len(ids) and ids.max() > 0xFFFF:
        return pa.array([x.astype("<u2" if x.max() <= 0xFFFF else "<u4").tobytes() for x in np.split(ids, ends)[:-1]], pa.binary())
    offsets = np.concatenate(([0], 2 * ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])


def write_token_files(
    docs: DataFrame, folder: str, path: str, kind: str = "byte", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", page_tokens: int = 1 << 18
) -> None:
    """Encode every text, append `end_id`, and write `folder`/pages and `folder`/ranks.

    Texts are encoded where they are read; only their ids are then dealt by ranges of the document's id, so that
    parts and pages follow its order. Rows without an id stand first, rows that repeat one side by side (in the
    order of a hash of their texts). Null texts are empty: the end id alone. The ranks come from the counts of
    ids over all documents, which each task sums up as it encodes (at most one row for each id of the
    vocabulary reaches the driver).
    """
    spark = docs.sparkSession
    fields = {"doc_id": pa.int64(), "key": pa.int64(), "row": pa.int64(), "n": pa.int32(), "ids": pa.binary(), "counts": pa.binary()}

    def encode(batches):
        enc, total = encoder(path, kind, CACHE_WORDS), np.zeros(end_id + 1, dtype=np.int64)
        for batch in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
            ids, ends = with_end(*enc.encode_array(batch.column(3).cast(pa.string())), end_id)
            more = np.bincount(ids, minlength=len(total))
            more[: len(total)] += total
            total = more
            rows = [*batch.columns[:3], pa.array(np.diff(ends, prepend=0), pa.int32()), id_bytes(ids, ends), pa.nulls(len(ends), pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=list(fields))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, -1, None, total.astype("<i8").tobytes()), fields.values(), strict=True)], names=list(fields))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    plain = rows.mapInArrow(lean(encode), "doc_id long, key long, row long, n int, ids binary, counts binary")
    schema = plain.schema
    plain.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": 1, "parquet.enable.dictionary": "false"}).parquet(f"{folder}/plain")
    plain = spark.read.schema(schema).parquet(f"{folder}/plain")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                more = np.frombuffer(c, "<i8").copy()
                if len(more) < len(total):
                    total, more = more, total.copy()
                more[: len(total)] += total
                total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])

    counts = plain.where("counts is not null").select("counts").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.toArrow().sort_by([("n", "descending"), ("id", "ascending")])["id"].to_numpy()
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(ranked)], "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))

    def pack(batches):
        n_page, before, tokens = 0, 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal n_page, before, tokens
            blob = page([d for d, _ in held], np.array([len(x) for _, x in held]), rank_of[np.concatenate([x for _, x in held])])
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([n_page], pa.int32()), pa.array([before], pa.int64()), pa.array([tokens], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "page", "before", "n_tokens", "blob"],
            )
            n_page, before, tokens = n_page + 1, before + tokens, 0
            held.clear()
            return row

        for batch in batches:
            for doc, part, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                held.append((doc, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")))
                tokens += n
                if tokens >= page_tokens:
                    yield flush()
        if held:
            yield flush()

    order = ["doc_id", "key", "row"]
    dealt = plain.where("n >= 0").select(*order, "n", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    pages = dealt.select("doc_id", F.spark_partition_id().alias("part"), "n", "ids").mapInArrow(lean(pack), "part int, page int, before long, n_tokens long, blob binary")
    pages.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": 1, "parquet.enable.dictionary": "false"}).parquet(f"{folder}/pages")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/plain")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    A part's start is the sum over the parts before it: one small row for each part is summed in order,
    and each page states its place within its part.
    """
    pages = spark.read.parquet(f"{folder}/pages")
    id_of = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], dtype=np.uint32)
    parts = pages.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batches):
        for batch in batches:
            for start, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                docs, counts, ranks = open_page(blob)
                ids = id_of[ranks].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                cut = [ids[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                for at in range(0, len(cut), 256):
                    own = slice(at, at + 256)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[own], pa.int64()),
                            pa.array(start + ends[own] - counts[own]),
                            pa.array(counts[own].astype(np.int64)),
                            pa.array([zlib.crc32(x.tobytes()) for x in cut[own]], pa.int64()),
                            pa.array([x.tobytes() for x in cut[own]], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    # One row for each part that was written: no more than the partitions of one shuffle.
    placed = pages.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "blob")
    return placed.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 0, **how) -> DataFrame:
    """Write the documents' token files to a new shared folder and return what the files give back."""
    folder = shared_dir(docs.sparkSession, "tokens")
    write_token_files(docs, folder, path, kind, end_id, **how)
    return read_token_files(docs.sparkSession, folder)
