"""Corpus pipeline: quality, exact copies, near copies, packing; each stage's rows are written and read again."""

from __future__ import annotations

import public_tokenizers

from reelspark.llm.common import stored, table
from reelspark.llm.exact_dedup import drop_copies
from reelspark.llm.near_dedup import drop_near
from reelspark.llm.packing import pack_documents
from reelspark.llm.quality import keep_good


#: Rows of a batch that goes to a Python worker: whole texts may be long, and a stage holds some batches at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark, most: int = 2000) -> None:
    """No more than `most` texts go to Python at once from here on; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= most:
        spark.conf.set(BATCH_ROWS, str(most))


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier (operator 10) rejects go.

    Null and empty texts are scored like others, by their statistics; rows that repeat and null ids too.
    """
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark, docs, sf_dir):
    """Of equal texts the one with the largest id stays (operator 2); null counts as empty.

    Rows that repeat an id and a text share one fate; a row without an id stays only if no equal text has one.
    """
    return drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    """Of near copies (five-word shingles, similarity 0.8 or more) the smallest id of each group stays (operator 8).

    Rows without an id or without words stay; different texts under one id are told apart.
    """
    small_batches(spark)
    return drop_near(docs, size=5, percent=80)


def packing_stage(spark, docs, sf_dir):
    """What is left is packed into sequences of at most 4096 tokens (operator 9); null and empty texts are one end token each."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1, size=4096, cache_words=200_000)


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_stage), ("minhash_near_dedup", near_stage), ("best_fit_packing", packing_stage)]

#: A learned classifier and a tokenizer can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole documents; other columns are carried along up to packing, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
