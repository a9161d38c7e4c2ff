"""Frame selection: filters, samples and limits, all within a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators import scan


def explode_frames(tracking: DataFrame) -> DataFrame:
    """(video_id, frame, athletes); of a frame that stands twice in a document the last one counts.

    Settled within the row: frames are sorted by number and place, and each but the last of equal numbers goes.
    """
    keyed = F.transform("frames", lambda f, i: F.struct(f["frame"].alias("frame"), i.alias("pos"), f["athletes"].alias("athletes")))
    rows = tracking.select("video_id", F.array_sort(keyed).alias("f")).where("f is not null")
    after = F.concat(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), F.array(F.get(F.slice("f", 1, 1), F.lit(1))))
    last = F.zip_with("f", after, lambda x, y: F.when(y.isNull() | ~x["frame"].eqNullSafe(y["frame"]), x))
    return rows.select("video_id", F.explode(F.filter(last, lambda x: x.isNotNull())).alias("f")).select("video_id", "f.frame", "f.athletes")


def last_frames(rows: DataFrame) -> DataFrame:
    """As explode_frames for frames that are rows already (video_id, pos, frame, athletes), as of a document that was read in pieces."""
    return rows.groupBy("video_id", "frame").agg(F.max_by("athletes", "pos").alias("athletes"))


def sample_frames(df: DataFrame, n: int) -> DataFrame:
    """Frames whose number is a multiple of n."""
    if n < 1:
        raise ValueError("sampling rate must be 1 or more")
    return df.where(F.col("frame") % n == 0)


def limit_frames(df: DataFrame, max_frames: int | None, pieces: int | None = None) -> DataFrame:
    """The first frames of each video by number; None and 0 mean all.

    With `pieces` frames are numbered by ranges (`scan.numbered`), so that one long video is not one task.
    """
    if not max_frames:
        return df
    if max_frames < 0:
        raise ValueError("max_frames must not be negative")
    if pieces:
        return scan.numbered(df, ("frame",), pieces).where(F.col("rn") <= max_frames).drop("rn")
    w = Window.partitionBy("video_id").orderBy("frame")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_frames).drop("rn")


def readable_prefix(df: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames up to the first that can't be read: those within the video's length."""
    return df.join(videos.select("video_id", "total_frames"), "video_id").where("frame >= 0 and frame < total_frames").drop("total_frames")


def drop_empty_frames(df: DataFrame) -> DataFrame:
    """Frames with at least one athlete."""
    return df.where(F.size(F.coalesce("athletes", F.array().cast(df.schema["athletes"].dataType))) > 0)


def frame_sequence(videos: DataFrame, n: int = 1, max_frames: int | None = None) -> DataFrame:
    """(video_id, local_idx, frame) for all frames of a video, sampled and limited; local_idx counts from 0.

    A kept frame's ordinal is its number over n, so neither a sort nor a window is needed.
    """
    if n < 1 or (max_frames or 0) < 0:
        raise ValueError("n must be 1 or more and max_frames not negative")
    last = F.floor((F.col("total_frames") - 1) / n)
    if max_frames:
        last = F.least(last, F.lit(max_frames - 1))
    rows = videos.where("total_frames > 0").select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("local_idx"))
    return rows.withColumn("frame", F.col("local_idx") * n)


def evenly_spaced(df: DataFrame, k: int = 6) -> DataFrame:
    """At most k frames of a video at equal steps of their order: 0, step, 2 * step ... with step = max(1, n // k)."""
    order = Window.partitionBy("video_id").orderBy("frame")
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    rows = df.withColumns({"rn": F.row_number().over(order) - 1, "step": F.greatest(F.lit(1), F.floor(n / k))})
    return rows.where((F.col("rn") % F.col("step") == 0) & (F.col("rn") / F.col("step") < k)).drop("rn", "step")


def retain_latest(prompts_a: DataFrame, prompts_b: DataFrame, n: int = 30) -> DataFrame:
    """The n largest frames of each video and object in the union of two frame lists."""
    w = Window.partitionBy("video_id", "obj_id").orderBy(F.desc("frame"))
    rows = prompts_a.unionByName(prompts_b).distinct()
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
