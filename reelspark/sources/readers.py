"""Readers of documents and feeds. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark import schemas
from reelspark.sources.packed import read_lines, read_packed

#: Stands before each frame of a tracking document, and nowhere else: in a string its quotes would be escaped.
FRAME_MARK = '"frame":'


def _documents(spark: SparkSession, path: str, schema: str, packed: bool) -> DataFrame:
    if packed:
        return read_packed(spark, path).select("video_id", F.from_json("document", schema).alias("d")).select("d.*", "video_id")
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("video_id", _file_video())


def _file_video():
    """The video's id: the folder's (video_id=...), or else the file's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/video_id=([^/]*)/", 1)
    return F.coalesce(F.nullif(folder, F.lit("")), F.regexp_replace(name, r"\.[^.]*$", ""))


def read_tracking(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Tracking documents, one a row: of one a file, with the video_id of the folder (video_id=...) or the file's name, or as `write_tracking` packs them.

    Documents with more frames than a row should hold are read by `read_tracking_frames`.
    """
    return _documents(spark, path, schemas.TRACKING, packed)


def read_tracking_frames(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(video_id, pos, frame, timestamp, athletes) of tracking documents of any length; pos orders a document's frames.

    A file is cut at its frames and read by as many tasks as its bytes ask for (`spark.sql.files.maxPartitionBytes`). That asks
    for documents whose frames begin with their number, as they are written; others fail with an error and are
    read whole by `read_tracking`. A file without frames gives no rows.
    """
    kind = schemas.TRACKING.split("frames array<")[1][:-1]
    if packed:
        # quotes in an id are escaped, so that the first match is the line's own; a line is parsed once, by what its document is
        listed = F.regexp_extract("value", r',"document":\s*(.)', 1) == "["
        parsed = lambda kind: F.from_json("value", f"video_id string, seq int, document {kind}")
        rows = read_lines(spark, path).select(F.when(listed, parsed(f"array<{kind}>")).alias("a"), F.when(~listed, parsed(f"struct<frames: array<{kind}>>")).alias("b"))
        either = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
        rows = rows.select(either("video_id"), either("seq"), F.posexplode(F.coalesce("a.document", "b.document.frames")).alias("at", "f"))
        return rows.select("video_id", F.struct(F.col("seq").cast("long").alias("block"), F.col("at").cast("long").alias("at")).alias("pos"), "f.frame", "f.timestamp", "f.athletes")
    texts = spark.read.option("lineSep", FRAME_MARK).text(path)
    rows = texts.select(_file_video().alias("video_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # a piece is a frame after its mark, and then what leads to the next frame or ends the document
    inner = F.regexp_replace("value", r"\}\s*,\s*\{\s*$", "}")
    frame = F.from_json(F.concat(F.lit('[{"frame":'), inner, F.lit("]")), f"array<{kind}>")
    # the last frame, up to the end of the list
    last = F.from_json(F.concat(F.lit('{"frames":[{"frame":'), "value"), f"struct<frames: array<{kind}>>")["frames"]
    ends = ~F.col("value").rlike(r"\}\s*,\s*\{\s*$")
    first = F.startswith(F.ltrim("value"), F.lit("{"))
    odd = first & F.col("value").rlike(r'"frames"\s*:\s*\[\s*\{') & ~F.col("value").rlike(r'"frames"\s*:\s*\[\s*\{\s*$')
    rows = rows.where(~first | odd).withColumn("f", F.get(F.when(ends, last).otherwise(frame), F.lit(0)))
    bad = F.raise_error(F.concat(F.lit("no frame that begins with its number, in "), "video_id")).cast("bigint")
    number = F.when(F.col("f.frame").isNull(), bad).otherwise(F.col("f.frame"))
    return rows.select("video_id", F.struct("block", "at").alias("pos"), number.alias("frame"), "f.timestamp", "f.athletes")


def read_detections(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Detection documents, one a file, or as `write_detections` packs them."""
    return _documents(spark, path, schemas.DETECTIONS, packed)


def explode_persons(detections: DataFrame) -> DataFrame:
    """One row per person of detection documents; det_idx counts from 0."""
    rows = detections.select("video_id", "frame_idx", F.posexplode("persons").alias("det_idx", "p"))
    return rows.select("video_id", "frame_idx", "det_idx", "p.box", "p.confidence", "p.track_id")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSES).json(path)


def read_messages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The message feed as a table, or as a stream of new files."""
    return (spark.readStream if streaming else spark.read).schema(schemas.ENVELOPE).json(path)


def read_job_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests, one JSON object a line, as values of any kind in `request`; a line that is none stands in _corrupt_record.

    The fields stand beside it as text; only `request` tells an absent field from null, and text from numbers.
    """
    rows = spark.read.text(path).where("trim(value) <> ''").withColumn("request", F.try_parse_json("value"))
    good = F.startswith(F.schema_of_variant("request"), F.lit("OBJECT"))
    rows = rows.withColumn("request", F.when(good, F.col("request")))
    fields = [F.try_variant_get("request", f"$.{c}", "string").alias(c) for c in schemas.REQUEST_FIELDS]
    return rows.select(*fields, "request", F.when(F.col("request").isNull(), F.col("value")).alias("_corrupt_record"))
