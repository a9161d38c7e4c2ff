"""Writers of documents and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.sources.packed import write_packed


def _json(*cols: str, nulls: bool = True):
    return F.to_json(F.struct(*cols), {"ignoreNullFields": str(not nulls).lower()})


def raw_log(records: DataFrame) -> DataFrame:
    """(video_id, value): the raw log of each video, windows in order; window is a number or "final".

    An analysis is written as it came: `records` has it as JSON text in analysis_json, or typed in analysis.
    """
    number = F.when(F.col("is_final"), F.to_json(F.struct("window"))).otherwise(F.regexp_replace(F.to_json(F.struct("window")), r'"window":"(\d+)"', r'"window":$1'))
    if "analysis_json" in records.columns:
        # what is no space or tab between tokens can only be a line feed or carriage return
        told = F.concat(F.lit(',"analysis":'), F.regexp_replace("analysis_json", r"[\r\n]+", " "))
    else:
        told = F.concat(F.lit(',"analysis":'), F.to_json("analysis"))
    rest = F.concat(F.coalesce(F.concat(F.lit(',"frames":'), F.to_json("frames")), F.lit("")), F.coalesce(told, F.lit("")))
    bad = F.concat(F.lit(","), F.expr("substring(to_json(struct(raw_error)), 2)"))
    good = F.concat(rest, F.lit("}"))
    one = F.concat(F.expr("substring(n, 1, length(n) - 1)"), F.when(F.col("raw_error").isNull(), good).otherwise(bad))
    rows = records.withColumn("n", number).withColumn("j", one)
    grouped = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("is_final", "window_no", "j"))).alias("rows"))
    return grouped.select("video_id", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]")).alias("value"))


def write_raw(records: DataFrame, path: str) -> None:
    """The raw log of each video, many in a file."""
    write_packed(raw_log(records), path)


def write_result(results: DataFrame, path: str) -> None:
    """Result documents (match_summary, clips, fps), many in a file; clips may be maps of values of any kind."""
    write_packed(results.withColumn("value", _json("match_summary", "clips", "fps")), path)


def message_rows(messages: DataFrame) -> DataFrame:
    """(key, value, headers) in the layout that a Kafka sink takes."""
    headers = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))
    return messages.select(F.col("video_id").cast("string").alias("key"), F.col("body").alias("value"), headers.alias("headers"))


def write_messages(messages: DataFrame, path: str, format: str = "parquet", **options) -> None:
    """Write messages to files, or with format="kafka" and its options to a topic."""
    writer = message_rows(messages).write.format(format).options(**options)
    writer.save() if format == "kafka" else writer.mode("append").save(path)


def write_tracking(docs: DataFrame, path: str) -> None:
    """Tracking documents, many in a file: whole ones, or the fragments of `tracking.tracking_fragments`."""
    write_packed(docs if "value" in docs.columns else docs.withColumn("value", _json("video", "model", "fps", "video_size", "num_objects", "frames")), path)


def write_detections(dets: DataFrame, path: str) -> None:
    """Detection documents, many in a file, from one row per person (video_id, frame_idx, track_id, box, confidence).

    video is the column of that name, else the video's id; video_size is an array column, empty without it. The frame's
    number stands as seq.
    """
    named = {"video": F.col("video_id").cast("string"), "video_size": F.array().cast("array<int>")}
    dets = dets.withColumns({k: v for k, v in named.items() if k not in dets.columns})
    person = F.struct("track_id", "box", "confidence")
    docs = dets.groupBy("video_id", "frame_idx").agg(F.first("video").alias("video"), F.first("video_size").alias("video_size"), F.array_sort(F.collect_list(person)).alias("persons"))
    write_packed(docs.select("video_id", F.col("frame_idx").alias("seq"), _json("video", "frame_idx", "video_size", "persons").alias("value")), path)
