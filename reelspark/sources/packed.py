"""Many JSON documents in few files, with a manifest by which each can be read alone.

A file has one line for each document, or for each fragment of a long one:
{"video_id":"7","seq":0,"document":...}. The manifest has the file's folder, and the first byte and the number of bytes of what
stands under "document". Files and manifest become visible together, as a version of the table (`commits`).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.sources.commits import Versions

#: Bytes of a file, on average. A file holds whole documents, so one with a longer document is longer.
FILE_BYTES = 128 << 20
LINES = "video_id string, seq int, document string"


def write_packed(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write (video_id, value), with a column seq where documents come as fragments, as the table's next version.

    value is JSON text without line feeds; rows without one are left out. Of a long document, fragment 0 is an object
    without its last field and the others are arrays of that field's items, in order. The rows are written once as they are,
    so that they are computed once, and then dealt by a hash of the video into as many files as their bytes ask for. A
    task streams its file's rows in order; no document is ever one row unless it came as one.
    """
    spark, v = rows.sparkSession, Versions(rows.sparkSession, path)
    seq = F.col("seq").cast("int") if "seq" in rows.columns else F.lit(0)
    rows = rows.where("value is not null").select(F.col("video_id").cast("string").alias("video_id"), seq.alias("seq"), "value")
    # the id as a JSON string, cut out of {"k":...}
    named = F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col("video_id").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1), F.lit(""))
    named = F.when(F.col("video_id").isNull(), F.lit("null")).otherwise(named)
    head = F.concat(F.lit('{"video_id":'), named, F.lit(',"seq":'), F.col("seq").cast("string"), F.lit(',"document":'))
    lines = rows.withColumn("head", head).select("video_id", "seq", F.concat("head", "value", F.lit("}")).alias("value"), F.octet_length("head").alias("before"), F.octet_length("value").alias("length"))
    base, staged = v.newest(), v.new_folder()
    lines.write.parquet(f"{v.path}/{staged}")
    held = spark.read.schema(lines.schema).parquet(f"{v.path}/{staged}")
    size = held.agg(F.sum(F.col("length").cast("long") + F.col("before") + 2)).first()[0] or 0
    n, folder = max(1, -(-size // file_bytes)), v.new_folder()
    dealt = held.withColumn("file", F.pmod(F.xxhash64("video_id"), F.lit(n)))
    out = dealt.repartition(n, "file").sortWithinPartitions("file", "video_id", "seq")
    out.select("file", "value").write.partitionBy("file").option("maxRecordsPerFile", 0).text(f"{v.path}/{folder}/lines")
    # the numbers alone are sorted again; texts stay where they are
    order = Window.partitionBy("file").orderBy("video_id", "seq")
    end = F.sum(F.col("length").cast("long") + F.col("before") + 2).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    listed = dealt.select("file", "video_id", "seq", (end - F.col("length") - 2).alias("at"), F.col("length").cast("long").alias("length"))
    listed.write.parquet(f"{v.path}/{folder}/manifest")
    v.commit(base, {"all": {"lines": f"{folder}/lines", "manifest": f"{folder}/manifest", "files": n}} if size else {})
    v.remove([staged])
    v.clean()


def _version(spark: SparkSession, path: str) -> dict | None:
    return Versions(spark, path).newest()["parts"].get("all")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, seq, document) of every document or fragment, as text; files are read by as many tasks as their bytes ask for."""
    part = _version(spark, path)
    if part is None:
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).json(f"{path.rstrip('/')}/{part['lines']}").select("video_id", "seq", "document")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of the table as text, for readers that parse line and document at once."""
    part = _version(spark, path)
    return spark.createDataFrame([], "value string") if part is None else spark.read.text(f"{path.rstrip('/')}/{part['lines']}").select("value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, video_id, seq, at, length): where each document or fragment stands; at is its first byte."""
    part = _version(spark, path)
    if part is None:
        return spark.createDataFrame([], "file long, video_id string, seq int, at long, length long")
    return spark.read.parquet(f"{path.rstrip('/')}/{part['manifest']}")


def read_document(spark: SparkSession, path: str, video_id, items: str = "frames") -> str | None:
    """The text of one video's document, from its bytes alone; `items` is the field whose items fragments hold."""
    v = Versions(spark, path)
    part = v.newest()["parts"].get("all")
    found = read_manifest(spark, path).where(F.col("video_id") == str(video_id)).orderBy("seq").collect()
    if not found:
        return None
    folder = v._path(f"{part['lines']}/file={found[0]['file']}")
    file = next(s.getPath() for s in v.fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    stream, texts = v.fs.open(file), []
    try:
        for r in found:
            stream.seek(r["at"])
            limited = v._jvm.org.apache.commons.io.input.BoundedInputStream(stream, r["length"])
            texts.append(v._jvm.org.apache.commons.io.IOUtils.toString(limited, "UTF-8"))
    finally:
        stream.close()
    if len(texts) == 1:
        return texts[0]
    inner = ",".join(t.strip()[1:-1] for t in texts[1:])
    return f"{texts[0].rstrip()[:-1]},{json.dumps(items)}:[{inner}]}}"
