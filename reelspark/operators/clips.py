"""Clips: the central analytic. Neighbours of one category that overlap or nearly touch become one clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators import scan

FIELDS = ("category", "specific_technique", "role", "reasoning", "confidence", "clip")


def explode_clips(parsed: DataFrame) -> DataFrame:
    """One row per clip; pos orders clips by window and place; clip is all of it as the model gave it (VARIANT).

    A field of another type than expected is null beside it. Without a column body, clip is made of the typed fields.
    """
    good = parsed.where("parse_ok")
    typed = F.coalesce("analysis.clips", F.array().cast(parsed.schema["analysis"].dataType["clips"].dataType))
    if "body" in parsed.columns:
        whole = F.try_variant_get(F.try_parse_json("body"), "$.clips", "array<variant>")
        both = F.arrays_zip(typed.alias("typed"), whole.alias("whole"))
        rows = good.select("video_id", "is_final", "window_no", F.posexplode(F.transform(both, lambda x: F.struct(x["typed"].alias("t"), x["whole"].alias("w")))).alias("idx", "c"))
        rows = rows.select("video_id", "is_final", "window_no", "idx", F.col("c.t").alias("t"), F.col("c.w").alias("w"))
    else:
        rows = good.select("video_id", "is_final", "window_no", F.posexplode(typed).alias("idx", "t")).withColumn("w", F.to_variant_object(F.col("t")))
    return rows.select("video_id", F.struct("is_final", "window_no", "idx").alias("pos"), "t.*", F.col("w").alias("clip"))


def quarantine_clips(clips: DataFrame, mode: str = "SPLIT") -> tuple[DataFrame, DataFrame]:
    """(good, rejected): clips without frames or with NaN confidence are rejected with a reason, or fail the job in FAILFAST mode."""
    c = F.col
    reason = F.when(c("start_frame").isNull(), "no start_frame").when(c("end_frame").isNull(), "no end_frame").when(F.isnan(F.coalesce("confidence", F.lit(0.0))), "confidence is NaN")
    marked = clips.withColumn("reason", reason)
    if mode == "FAILFAST":
        good = marked.where(F.when(c("reason").isNotNull(), F.raise_error(F.concat(F.lit("bad clip: "), "reason")).cast("boolean")).otherwise(True)).drop("reason")
        return good, marked.limit(0)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def _islands(clips: DataFrame, gap: int) -> DataFrame:
    """`clips` with rank and island, by windows within a video."""
    w = Window.partitionBy("video_id").orderBy("start_frame", "pos")
    same = F.col("category").eqNullSafe(F.lag("category").over(w)) & (F.row_number().over(w) > 1)
    rows = clips.withColumns({"change": F.when(same, 0).otherwise(1), "rank": F.row_number().over(w)})
    rows = rows.withColumn("run", F.sum("change").over(w))
    prev = F.max("end_frame").over(Window.partitionBy("video_id", "run").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prev", prev).withColumn("breaks", F.when(F.col("prev").isNull() | (F.col("start_frame") - F.col("prev") >= gap), 1).otherwise(0))
    return rows.withColumn("island", F.sum("breaks").over(Window.partitionBy("video_id").orderBy("rank")))


def merge_clips(clips: DataFrame, gap: int = 30, pieces: int | None = None) -> DataFrame:
    """Merge neighbours in order of start_frame that share a category and lie less than `gap` frames apart.

    Columns video_id, pos, start_frame, end_frame and those of FIELDS that exist; the result has clip_no
    (from 1 by start) and n_clips. The other fields come from the clip with the greatest confidence (null
    counts as 0), the earliest of equals; among them clip, with every key that the model gave it. One exchange: all
    windows and the grouping stay within a video. With `pieces` the table is cut into so many ranges instead
    (`scan.islands`), for tables in which one video has a large part of all clips.
    """
    fields = [f for f in FIELDS if f in clips.columns]
    rows = scan.islands(clips, gap, pieces) if pieces else _islands(clips, gap)
    best = F.max_by(F.struct(*fields), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("rank")))
    merged = rows.groupBy("video_id", "island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), best.alias("best"), F.count(F.lit(1)).alias("n_clips"))
    return merged.select("video_id", F.col("island").alias("clip_no"), "start_frame", "end_frame", *[F.col(f"best.{f}").alias(f) for f in fields], "n_clips")


def whole_clip(start: Column, end: Column, clip: Column) -> Column:
    """A clip's keys and values as the model gave them, with the frames of the merged clip: map<string, variant>."""
    given = F.map_filter(F.try_variant_get(clip, "$", "map<string,variant>"), lambda k, v: ~k.isin("start_frame", "end_frame"))
    frames = F.create_map(F.lit("start_frame"), start.cast("variant"), F.lit("end_frame"), end.cast("variant"))
    return F.map_concat(frames, F.coalesce(given, F.create_map().cast("map<string,variant>")))


def result_document(merged: DataFrame, videos: DataFrame, mode: str = "single") -> DataFrame:
    """One row per video: match_summary, its clips in order (possibly none) and fps.

    Where `merged` has clip, clips are maps of all keys that the models gave; else structs of the columns there are.
    """
    cols = [c for c in ("start_frame", "end_frame", *FIELDS) if c in merged.columns]
    if "clip" in cols:
        merged, cols = merged.withColumn("clip", whole_clip(F.col("start_frame"), F.col("end_frame"), F.col("clip"))), ["clip"]
    item = F.struct(F.col("clip_no").alias("clip_no"), F.struct(*cols).alias("c"))
    grouped = merged.groupBy("video_id").agg(F.collect_list(item).alias("c"))
    # maps and variants have no order, so places are sorted and clips fetched by them
    place = F.array_sort(F.transform("c", lambda x, i: F.struct(x["clip_no"].alias("clip_no"), i.alias("i"))))
    grouped = grouped.withColumn("place", place)
    one = (lambda c: c["clip"]) if cols == ["clip"] else (lambda c: c)
    grouped = grouped.select("video_id", F.transform("place", lambda p: one(F.get("c", p["i"])["c"])).alias("clips"))
    rows = videos.join(grouped, "video_id", "left")
    summary = "Analysis generated via Multi-Agent" if mode == "multi" else "Analysis generated via Single-Agent"
    none = F.array().cast(grouped.schema["clips"].dataType)
    return rows.select("video_id", F.lit(summary).alias("match_summary"), F.coalesce("clips", none).alias("clips"), "fps")
