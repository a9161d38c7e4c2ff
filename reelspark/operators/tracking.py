"""Tracking documents from tracked boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Frames of a fragment.
FRAGMENT_FRAMES = 1000


def _by_frame(tracks: DataFrame, frame_map: DataFrame) -> DataFrame:
    """(video_id, local_idx, frame, athletes), frames without athletes with none. No item is null: sort_array compares each pair once, natively."""
    athlete = F.struct("track_id", "box", "mask_area")
    by_frame = tracks.groupBy("video_id", "local_idx").agg(F.sort_array(F.collect_list(athlete)).alias("athletes"))
    none = F.array().cast(by_frame.schema["athletes"].dataType)
    rows = frame_map.join(by_frame, ["video_id", "local_idx"], "left")
    return rows.select("video_id", "local_idx", F.coalesce("frame", "local_idx").alias("frame"), F.coalesce("athletes", none).alias("athletes"))


def _num_objects():
    """Tracks of the first frame that has any."""
    return F.coalesce(F.min_by(F.size("athletes"), F.when(F.size("athletes") > 0, F.col("local_idx"))), F.lit(0)).alias("num_objects")


def _named(videos: DataFrame):
    return F.col("video") if "video" in videos.columns else F.col("video_id").cast("string")


def tracking_document(tracks: DataFrame, frame_map: DataFrame, videos: DataFrame, model: str = "tracker") -> DataFrame:
    """One document per video; frames in order of their local index, those without athletes kept with none.

    tracks (video_id, local_idx, track_id, box, mask_area), frame_map (video_id, local_idx, frame; a null
    frame is its local index), videos (video_id, width, height, fps). num_objects counts the tracks of the
    first frame that has any. video is the file's name where `videos` has it, else the video's id. A whole video is one
    row; `tracking_fragments` makes documents of any length.
    """
    item = F.struct("local_idx", "frame", "athletes")
    docs = _by_frame(tracks, frame_map).groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("f"), _num_objects())
    frames = F.transform("f", lambda x: F.struct(x["frame"].alias("frame"), x["athletes"].alias("athletes")))
    out = docs.join(videos, "video_id")
    return out.select("video_id", _named(videos).alias("video"), F.lit(model).alias("model"), "fps", F.array("width", "height").alias("video_size"), "num_objects", frames.alias("frames"))


def tracking_fragments(tracks: DataFrame, frame_map: DataFrame, videos: DataFrame, model: str = "tracker", per: int = FRAGMENT_FRAMES) -> DataFrame:
    """(video_id, seq, value): the documents of tracking_document as JSON text for `write_tracking`, however many frames they have.

    A document whose local indices all lie within one step of `per` is one text. A longer one has its
    header as fragment 0, and for each step of local indices an array of its frames: neither a row nor a task has a whole video.
    """
    item = F.struct("local_idx", "frame", "athletes")
    rows = _by_frame(tracks, frame_map).withColumn("step", F.floor(F.col("local_idx") / per))
    steps = rows.groupBy("video_id", "step").agg(F.sort_array(F.collect_list(item)).alias("f"), _num_objects(), F.min(F.when(F.size("athletes") > 0, F.col("local_idx"))).alias("first"))
    frames = F.transform("f", lambda x: F.struct(x["frame"].alias("frame"), x["athletes"].alias("athletes")))
    steps = steps.select("video_id", "step", "num_objects", "first", F.to_json(frames).alias("frames"))
    heads = steps.groupBy("video_id").agg(F.coalesce(F.min_by("num_objects", "first"), F.lit(0)).alias("num_objects"), F.count(F.lit(1)).alias("n"))
    heads = heads.join(videos, "video_id").select("video_id", "n", F.to_json(F.struct(_named(videos).alias("video"), F.lit(model).alias("model"), "fps", F.array("width", "height").alias("video_size"), "num_objects"), {"ignoreNullFields": "false"}).alias("head"))
    joined = steps.drop("num_objects").join(heads, "video_id")
    whole = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"frames":'), "frames", F.lit("}"))
    parts = joined.select("video_id", F.when(F.col("n") == 1, F.lit(0)).otherwise(F.col("step") + 1).cast("int").alias("seq"), F.when(F.col("n") == 1, whole).otherwise(F.col("frames")).alias("value"))
    return parts.unionByName(heads.where("n > 1").select("video_id", F.lit(0).alias("seq"), F.col("head").alias("value")))
