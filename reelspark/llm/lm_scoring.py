"""Cross-entropy difference of two matched bigram models over one shared vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import BROADCAST_ROWS, lean, shared_dir, stored
from reelspark.llm.near_dedup import _grouped
from reelspark.llm.shingles import mix, word_hashes

#: Tokens of a chunk (and its last texts), tokens for a block of keys, and blocks at least. They change no result.
CHUNK_TOKENS, BLOCK_TOKENS, LEAST_BLOCKS = 1 << 20, 1 << 20, 128
#: A key's lowest bit is 0 for a word and 1 for a pair. The start mark has a key of its own.
PAIR = np.uint64(1)
START = np.uint64(0x243F6A8885A308D2)

#: Counts in the two models, and of those the ones at the end of a text.
COUNTS = ("target", "background", "target_last", "background_last")
CHUNKS = "chunk long, ids array<long>, cut binary, flags binary, token binary, words binary, n_target long, n_background long"
#: A row of chunks is of some MB; unless told, Parquet looks at sizes every 100 rows only.
LARGE_ROWS = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false", "compression": "zstd"}


def _packed(a: np.ndarray) -> bytes:
    """The width and then the bytes of whole numbers by place, in as few as hold the largest."""
    k = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([k]) + a.astype("<u8").view(np.uint8).reshape(len(a), 8).T[:k].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    places = np.frombuffer(b, dtype=np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((places.shape[1], 8), dtype=np.uint8)
    out[:, : b[0]] = places.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b).view(np.uint64), dtype=np.uint64)


def keyed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens of each text, word key of each token).

    Tokens are runs of bytes other than white space after A-Z are lower-cased.
    """
    words, start = word_hashes(b"\n".join(texts).lower())
    cut = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return np.diff(cut), words & ~PAIR


def _chunk(number: int, ids: list, flags: list, parts: list) -> dict:
    """One row of CHUNKS: its words' keys, each once and in order, and its texts as numbers of words."""
    n, own = (np.concatenate([p[k] for p in parts]) for k in range(2))
    words, token = np.unique(np.concatenate(([START], own)), return_inverse=True)
    return {
        "chunk": number,
        "ids": ids,
        "cut": np.concatenate(([0], np.cumsum(n))).astype(np.int64).tobytes(),
        "flags": bytes(flags),
        "token": _packed(token[1:]),
        "words": _packed_keys(words),
        "n_target": int(n[np.array(flags, dtype=bool)].sum()),
        "n_background": int(n.sum()),
    }


def _pairs(row: dict) -> tuple[np.ndarray, ...]:
    """(cut, token, word before it, its pair, number of words, keys of words and then pairs, order of the keys) of a chunk."""
    cut, token, words = np.frombuffer(row["cut"], dtype=np.int64), _unpacked(row["token"]), _unpacked_keys(row["words"])
    start = np.searchsorted(words, START)
    before = np.concatenate(([start], token[:-1])) if len(token) else token.copy()
    before[cut[:-1][cut[:-1] < cut[1:]]] = start
    codes, pair = np.unique(before * len(words) + token, return_inverse=True)
    prior, own = codes // len(words), codes % len(words)
    keys = np.concatenate((words, mix(words[prior] * np.uint64(0xC2B2AE3D27D4EB4F) + words[own]) | PAIR))
    return cut, token, before, pair, len(words), keys, np.argsort(keys, kind="stable")


def chunks_of(rows: DataFrame) -> DataFrame:
    """The texts of `rows` (doc_id, text, target) in chunks of about a million tokens, stored."""
    spark, most = rows.sparkSession, CHUNK_TOKENS
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.list_(pa.int64()))) for c in CHUNKS.split(", ")])

    def run(batches):
        number, ids, flags, parts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for some, texts in _grouped(list(zip(batch.column(0).to_pylist(), marks, strict=True)), batch.column(1).cast(pa.binary()).to_pylist(), 4 * most):
                parts.append(keyed(texts))
                ids += [i for i, _ in some]
                flags += [f for _, f in some]
                size += len(parts[-1][1])
                if size >= most:
                    yield pa.RecordBatch.from_pylist([_chunk(number, ids, flags, parts)], schema)
                    number, ids, flags, parts, size = number + 1, [], [], [], 0
        if parts:
            yield pa.RecordBatch.from_pylist([_chunk(number, ids, flags, parts)], schema)

    path = shared_dir(spark, "lm-chunks")
    got = rows.select("doc_id", "text", "target").mapInArrow(lean(run), CHUNKS)
    got.write.options(**LARGE_ROWS).parquet(path)
    return spark.read.schema(got.schema).parquet(path)


def model_counts(chunks: DataFrame, blocks: int) -> DataFrame:
    """(chunk, block, COUNTS, n_words): for each chunk's keys in order, block by block, their counts over all chunks, stored.

    Of a word, the counts with _last say how often it ends a text, with nothing after it. Keys are dealt to `blocks` ranges; a chunk sends each key once, however often it has it. n_words sums up to
    the number of different words.
    """

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cut, token, _, pair, n_words, keys, order = _pairs(row)
                keys, n, in_target = keys[order], np.diff(cut), np.frombuffer(row["flags"], dtype=bool)
                n_pairs, counts, ends = len(keys) - n_words, [], []
                for texts in (in_target, np.ones(len(n), dtype=bool)):
                    picked = np.repeat(texts, n)
                    count = np.bincount(token[picked], minlength=n_words)
                    count[np.searchsorted(_unpacked_keys(row["words"]), START)] = np.count_nonzero(texts & (n > 0))
                    counts.append(np.concatenate((count, np.bincount(pair[picked], minlength=n_pairs)))[order])
                    ends.append(np.bincount(token[cut[1:][texts & (n > 0)] - 1], minlength=len(keys))[order])
                some, first = np.unique(((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), return_index=True)
                slices = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)]
                sliced = [pa.array([f(x[at]) for at in slices], pa.binary()) for f, x in ((_packed_keys, keys), *[(_packed, x) for x in (*counts, *ends)])]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([row["chunk"]] * len(some), pa.int64()), *sliced], names=["block", "chunk", "keys", *COUNTS])

    def count(rows: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(x) for x in rows["keys"].to_pylist()]
        cut = np.cumsum([len(x) for x in keys])[:-1]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        out = []
        for c in COUNTS:
            summed = np.bincount(inverse, weights=np.concatenate([_unpacked(x) for x in rows[c].to_pylist()])).astype(np.int64)
            out.append(pa.array([_packed(x) for x in np.split(summed[inverse], cut)], pa.binary()))
        words = np.zeros(len(keys), dtype=np.int64)
        words[0] = np.count_nonzero((every & PAIR == 0) & (every != START))
        return pa.table([rows["chunk"], rows["block"], *out, pa.array(words)], names=["chunk", "block", *COUNTS, "n_words"])

    kinds = ", ".join(f"{c} binary" for c in COUNTS)
    dealt = chunks.mapInArrow(lean(deal), f"block long, chunk long, keys binary, {kinds}")
    return stored(dealt.groupBy("block").applyInArrow(count, f"chunk long, block long, {kinds}, n_words long"), "lm-counts")


def token_losses(word: np.ndarray, pair: np.ndarray, followed: np.ndarray, total: np.ndarray, words: int, weight: float) -> np.ndarray:
    """Bits of tokens: of a word, a pair and how often the word before is followed by any, out of `total` tokens.

    weight * pair / followed + (1 - weight) * (word + 1) / (total + words), and the second part alone after a word
    that nothing follows: the probabilities of all words sum up to 1 after every word.
    """
    single = (word + 1.0) / (total + words)
    return -np.log2(np.where(followed > 0, weight * pair / np.maximum(1, followed) + (1 - weight) * single, single))


def _own(document: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its own document."""
    _, inverse, count = np.unique(document * (int(key.max(initial=0)) + 1) + key, return_inverse=True, return_counts=True)
    return count[inverse]


def score_documents(
    docs: DataFrame, target_ids: DataFrame | None = None, target: Column | None = None, weight: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, target_bits, background_bits, score per row; the lower the score, the closer to the target.

    The target model counts the documents in `target_ids` (a table with `id_col`) or those for which
    `target` holds; the background model counts all. Both share tokens, vocabulary and smoothing, and
    count every text as a whole. A document is scored by what the others have: from each model that counts it its own
    counts are left out. score is the mean over tokens of the target model's bits less the
    background model's. A document without tokens scores 0. Null texts are empty; null ids are scored,
    repeated rows one by one; other columns are ignored. Without target documents the target model is
    uniform over words.

    Words and pairs are told apart by 64-bit keys and all are counted: the counts are tables in the shared
    folder that grow with the texts, and neither the driver nor any task holds them all. Texts are read
    once, in chunks; a chunk sends its keys to the blocks that count them and gets their counts back. The
    vocabulary of the smoothing is all different words of the texts, so that each model is a distribution over them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(False) if target is None else F.coalesce(target, F.lit(False))).alias("target"))
    if target_ids is not None:
        ids = stored(target_ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "lm-target")
        few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        ids = ids.withColumn("in_target", F.lit(True))
        marked = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left").select("doc_id", "text", (F.col("target") | F.coalesce("in_target", F.lit(False))).alias("target"))
    else:
        marked = rows
    chunks = chunks_of(marked)
    totals = chunks.agg(*[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in ("target", "background")]).first().asDict()
    counts = model_counts(chunks, max(LEAST_BLOCKS, -(-totals["background"] // BLOCK_TOKENS)))
    words = counts.agg(F.sum("n_words")).first()[0] or 0

    def run(counted: pa.Table, chunk: pa.Table) -> pa.Table:
        counted, row = counted.sort_by("block"), chunk.to_pylist()[0]
        cut, token, before, pair, n_words, keys, order = _pairs(row)
        n, flags = np.diff(cut), np.frombuffer(row["flags"], dtype=bool)
        document, held = np.repeat(np.arange(len(n)), n), {}
        for c in COUNTS:
            held[c] = np.empty(len(keys), dtype=np.int64)
            held[c][order] = np.concatenate([_unpacked(x) for x in counted[c].to_pylist()])
        own, bits = [_own(document, x) for x in (token, pair, before)], []
        for c, total in totals.items():
            inside = (flags if c == "target" else np.ones(len(n), dtype=bool))[document].astype(np.int64)
            followed = (held[c] - held[f"{c}_last"])[before]
            losses = token_losses(held[c][token] - inside * own[0], held[c][n_words + pair] - inside * own[1], followed - inside * own[2], total - inside * n[document], words, weight)
            summed = np.concatenate(([0.0], np.cumsum(losses)))
            bits.append((summed[cut[1:]] - summed[cut[:-1]]) / np.maximum(1, n))
        return pa.table(
            [pa.array(row["ids"], pa.int64()), pa.array(np.diff(cut)), pa.array(bits[0]), pa.array(bits[1]), pa.array(bits[0] - bits[1])],
            names=["doc_id", "n_tokens", "target_bits", "background_bits", "score"],
        )

    texts = chunks.select("chunk", "ids", "cut", "flags", "token", "words")
    replies = counts.drop("n_words").groupBy("chunk")
    return replies.cogroup(texts.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, target_bits double, background_bits double, score double")
