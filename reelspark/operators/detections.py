"""Detections: filter, number, and pick by people's choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_persons(dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Persons (class 0) with confidence at or above the threshold; box to 1 decimal, confidence to 4."""
    rows = dets.where((F.col("class_id") == 0) & (F.col("confidence") >= threshold))
    return rows.withColumns({"box": F.transform("box", lambda x: F.bround(x, 1)), "confidence": F.bround("confidence", 4)})


def number_tracks(dets: DataFrame) -> DataFrame:
    """track_id: place among the detections that are left of a frame, from 1."""
    return dets.withColumn("track_id", F.row_number().over(Window.partitionBy("video_id", "frame_idx").orderBy("det_idx")))


def apply_picks(dets: DataFrame, picks: DataFrame) -> DataFrame:
    """The first two different detections that were picked become tracks 1 and 2; fewer than two give nothing.

    Picks are (video_id, pick_no, det_idx); unknown and repeated ones are passed over.
    """
    first = picks.groupBy("video_id", "det_idx").agg(F.min("pick_no").alias("pick_no"))
    w = Window.partitionBy("video_id")
    rows = dets.join(first, ["video_id", "det_idx"]).withColumns({"track_id": F.row_number().over(w.orderBy("pick_no", "det_idx")), "n": F.count(F.lit(1)).over(w)})
    return rows.where("n >= 2 and track_id <= 2").withColumn("box", F.transform("box", lambda x: F.bround(x, 1))).drop("n", "pick_no")
