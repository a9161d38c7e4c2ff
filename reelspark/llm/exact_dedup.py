"""Exact deduplication by a stream with keyed state that is kept on disk and never expires."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import lower_ascii, only_ids, shared_dir, stored, without

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches of changed states that are read again by every call; beyond that all states are written as one.
COMPACT_AFTER = 8


def digest_log(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """(doc_id, digest, text_sha256, n_bytes, locator) per row; the texts are read once and not carried along."""
    text = lower_ascii(F.col(text_col))
    sha = F.sha2(text.cast("binary"), 256)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (sha if digest is None else digest).alias("digest"),
        sha.alias("text_sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.input_file_name().alias("locator"),
    )


def fold_stream(log: DataFrame, state_dir: str, partitions: int | None = None) -> DataFrame:
    """Fold a streaming digest log into state: per digest the stable id, its content locator and a count.

    `log` is a streaming DataFrame; `state_dir` holds the stream's checkpoint (RocksDB state files) and
    the changed states of each batch. Called again with the same folder, it takes in only what is new.
    There is no watermark, so no state ever expires. Rows of a digest are summed within each task before
    the shuffle. Returns the current states (digest, keep_id, group_size, locator, n_bytes_low, n_bytes_high).
    """
    spark = log.sparkSession
    states = log.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.max_by("locator", "doc_id").alias("locator"),
        F.min("n_bytes").alias("n_bytes_low"),
        F.max("n_bytes").alias("n_bytes_high"),
    )
    changed = f"{state_dir}/changed"
    # A store is closed as soon as its part of a batch is committed: each open one holds some 4 MB of disk.
    store = "spark.sql.streaming.stateStore"
    keys = {f"{store}.providerClass": PROVIDER, f"{store}.unloadOnCommit": "true", f"{store}.rocksdb.boundedMemoryUsage": "true", f"{store}.rocksdb.changelogCheckpointing.enabled": "true"}
    # All stores of an executor share so much memory; what is beyond goes to disk.
    keys |= {f"{store}.rocksdb.maxMemoryUsageMB": "128", f"{store}.rocksdb.writeBufferSizeMB": "8"}
    if partitions:
        keys["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        query = (
            states.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_dir}/checkpoint")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{changed}/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return _latest(spark, state_dir, states.schema)


def _latest(spark: SparkSession, state_dir: str, schema) -> DataFrame:
    """The current states. Once there are many batches they are written as one table `upto=n`, and the batches that it holds go.

    A state only grows, so the latest version of each digest is the one with the largest count, and reading a version twice does no harm:
    a table counts only when it is whole, and until then the batches are all there.
    """
    def numbered(folder: str, key: str) -> list[int]:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{key}=") and _exists(spark, f"{folder}/{n}/_SUCCESS"))

    def remove(path: str) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    changed, whole = f"{state_dir}/changed", f"{state_dir}/whole"
    tables, batches = numbered(whole, "upto"), numbered(changed, "batch")
    upto = tables[-1] if tables else -1
    later = [n for n in batches if n > upto]
    files = [f"{whole}/upto={upto}"] * bool(tables) + [f"{changed}/batch={n}" for n in later]
    versions = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    latest = F.max(F.struct("group_size", "keep_id", "locator", "n_bytes_low", "n_bytes_high")).alias("s")
    states = versions.groupBy("digest").agg(latest).select("digest", "s.*")
    if len(later) <= COMPACT_AFTER:
        return states
    states.select(*[f.name for f in schema]).write.mode("overwrite").parquet(f"{whole}/upto={later[-1]}")
    for path in [f"{changed}/batch={n}" for n in batches] + [f"{whole}/upto={n}" for n in tables]:
        remove(path)
    return spark.read.schema(schema).parquet(f"{whole}/upto={later[-1]}")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_parquet(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.parquet(*files)


def fetched(rows: DataFrame, id_col: str, text_col: str, read: Callable) -> DataFrame:
    """(doc_id, digest, text_sha256, norm): the texts of logged rows, through their locators.

    Only the files that the locators name are read (their names reach the driver, as any listing of input files does).
    A row is known again by its file, id and text digest; one that is no longer there is an error, so that no hit stays unchecked.
    """
    spark, rows = rows.sparkSession, stored(rows.select("doc_id", "digest", "text_sha256", "locator").distinct(), "exact-located")
    files = [unquote(r["locator"]) for r in rows.select("locator").distinct().collect()]
    if not files:
        return rows.select("doc_id", "digest", "text_sha256", F.lit("").alias("norm"))
    text = lower_ascii(F.col(text_col))
    there = read(spark, files).select(F.col(id_col).cast("long").alias("id"), text.alias("norm"), F.sha2(text.cast("binary"), 256).alias("sha"), F.input_file_name().alias("file"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha")) & (F.col("locator") == F.col("file"))
    got = stored(rows.join(there, same).select("doc_id", "digest", "text_sha256", "norm"), "exact-fetched")
    if got.select("doc_id", "text_sha256").distinct().count() < rows.select("doc_id", "text_sha256").distinct().count():
        raise RuntimeError("texts of earlier rows are no longer where their locators say")
    return got


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Column | None = None,
    files_per_batch: int = 10_000,
    state_dir: str | None = None,
    read: Callable[[SparkSession, list[str]], DataFrame] | None = None,
    restate: bool = False,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, locator.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays. Every group with more than one row is a hit: its full texts are compared
    (their smallest and largest must be the same bytes), and a digest that covers different texts is
    grouped anew by text, so that a digest collision joins nothing. Ids should be unique: rows that
    repeat an id and a text share one fate. Rows without an id never beat others; a group of such rows
    only stays whole (keep_id null). An empty table gives no rows; other columns are ignored.
    `digest` replaces the SHA-256 as the key of the state.

    With a `state_dir`, calls go on from one another: rows of earlier calls are known by their digests, count in
    group_size and may be the ones that stay. `docs` is then new rows only. The texts of earlier rows that are hit
    are fetched through their locators: from a copy that each call leaves in `state_dir`, or, with `read`
    (spark, files -> rows with the same columns, such as `read_parquet`), from the files that `docs` come from,
    which must stay as they are. The rows of earlier calls that new ones join are not told again, though another row may
    now be the one that stays: with `restate` they are, as they stand now, and a column earlier tells them from the new ones.
    """
    spark, whole, number = docs.sparkSession, state_dir is None, uuid.uuid4().hex
    state_dir = state_dir or shared_dir(spark, "exact-state")
    if not whole and read is None:
        copy = f"{state_dir}/texts/call={number}"
        docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).write.parquet(copy)
        docs, read = spark.read.parquet(copy), read_parquet
    folder = f"{state_dir}/log"
    new = digest_log(docs, id_col, text_col, digest)
    # one folder of one layout for all calls: the stream's checkpoint knows which of its files it has taken in
    new.withColumn("call", F.lit(number)).write.mode("append").parquet(folder)
    every = spark.read.schema(new.schema.add("call", "string")).parquet(folder)
    log = every.where(F.col("call") == number).drop("call")
    if every.inputFiles():
        stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        states = fold_stream(stream, state_dir)
    else:
        states = spark.createDataFrame([], "digest string, keep_id long, group_size long, locator string, n_bytes_low long, n_bytes_high long")
    states = stored(states, "exact-states")

    hits = states.where("group_size > 1").select("digest")
    text = lower_ascii(F.col(text_col))
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("norm"), (F.sha2(text.cast("binary"), 256) if digest is None else digest).alias("digest"))
    full = only_ids(full, hits, "digest")
    earlier = every.where(F.col("call") != number).drop("call")
    if not whole:
        # one earlier row of each text: rows of one call were compared with one another when it was made
        touched = stored(only_ids(log, hits, "digest").select("digest").distinct(), "exact-touched")
        named = only_ids(earlier, touched, "digest").groupBy("digest", "text_sha256").agg(F.max(F.struct("doc_id", "locator")).alias("s")).select("digest", "text_sha256", "s.*")
        full = full.unionByName(fetched(named, id_col, text_col, read).select(full.columns))
    # Equal texts become one row within each task, so that a text with very many copies is shuffled once a task.
    mixed = full.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")
    mixed = stored(mixed, "exact-mixed")

    told = log.withColumn("earlier", F.lit(False))
    if restate and not whole:
        told = told.unionByName(only_ids(earlier, touched, "digest").withColumn("earlier", F.lit(True)))
    rows = told.join(states.drop("locator"), "digest", "left").select("doc_id", "digest", "keep_id", "group_size", "text_sha256", "n_bytes", "locator", "earlier")
    if not mixed.isEmpty():
        members = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("norm"), (F.sha2(text.cast("binary"), 256) if digest is None else digest).alias("digest"))
        members = members.join(mixed, "digest", "left_semi").select("doc_id", "digest", "norm")
        if not whole:
            members = members.unionByName(fetched(earlier.join(mixed, "digest", "left_semi"), id_col, text_col, read).select("doc_id", "digest", "norm"))
        texts = members.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        texts = texts.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).drop("norm")
        apart = rows.drop("keep_id", "group_size").join(mixed, "digest", "left_semi").join(texts, ["digest", "text_sha256"]).select(rows.columns)
        rows = rows.join(mixed, "digest", "left_anti").unionByName(apart)
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes", "locator"]
    return rows.select(*out, *["earlier"] * restate)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` without the rows that `exact_groups` drops, known by id and text; same columns.

    Rows that repeat an id and a text share one fate; of different texts under one id each has its own.
    """
    out = exact_groups(docs, id_col, text_col, **how).where("not kept").select("doc_id", "text_sha256").distinct()
    return without(docs, out, {"doc_id": F.col(id_col).cast("long"), "text_sha256": F.sha2(lower_ascii(F.col(text_col)).cast("binary"), 256)})
