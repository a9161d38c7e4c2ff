"""Count-based windows over a video's frames, prompts and role reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators import scan


def sliding_windows(frames: DataFrame, size: int = 30, stride: int = 15, pieces: int | None = None) -> DataFrame:
    """(video_id, window_no, is_final, frames): full windows and a final one with what stands past the last stride.

    A video of n frames has m = (n - size) // stride + 1 full windows (0 if n < size); the final window,
    number m + 1, has the frames from ordinal m * stride on, which the last full one may hold already.
    Each frame is sent only to the windows it belongs to. With `pieces` frames are numbered by ranges (`scan.numbered`) and counted
    in parts, so that one long video is not one task.
    """
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be 1 or more")
    s = min(stride, size)
    by = Window.partitionBy("video_id")
    rows = frames.select("video_id", "frame")
    if pieces:
        rows = scan.numbered(rows, ("frame",), pieces).withColumn("rn", F.col("rn") - 1)
        rows = rows.join(frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")), "video_id")
    else:
        rows = rows.withColumns({"rn": F.row_number().over(by.orderBy("frame")) - 1, "n": F.count(F.lit(1)).over(by)})
    rows = rows.withColumn("m", F.when(F.col("n") < size, 0).otherwise(F.floor((F.col("n") - size) / s) + 1).cast("int"))
    low = F.greatest(F.lit(0), F.floor((F.col("rn") - size) / s) + 1).cast("int")
    high = F.least(F.floor(F.col("rn") / s), F.col("m") - 1).cast("int")
    none = F.array().cast("array<int>")
    full = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(none)
    final = F.when(F.col("rn") >= F.col("m") * s, F.array(F.col("m"))).otherwise(none)
    rows = rows.select("video_id", "frame", "m", F.explode(F.concat(full, final)).alias("k"))
    out = rows.groupBy("video_id", "k", "m").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    return out.select("video_id", (F.col("k") + 1).alias("window_no"), (F.col("k") == F.col("m")).alias("is_final"), "frames")


def number_windows(windows: DataFrame) -> DataFrame:
    """window: the number as text, or "final"."""
    return windows.withColumn("window", F.when(F.col("is_final"), "final").otherwise(F.col("window_no").cast("string")))


def build_prompts(windows: DataFrame, mode: str = "single") -> DataFrame:
    """prompt per window from its frames and the context before it (column context).

    In single mode an empty context reads "Start of the match."; in multi mode it is printed as it is.
    """
    listed = F.concat(F.lit("["), F.concat_ws(", ", F.col("frames").cast("array<string>")), F.lit("]"))
    if mode == "single":
        context = F.coalesce(F.nullif("context", F.lit("")), F.lit("Start of the match."))
        text = F.format_string("Frames in this window: %d. Frame numbers: %s. Context so far: %s. Answer with JSON: current_context_summary and clips.", F.size("frames"), listed, context)
    else:
        text = F.format_string("Report on %d frames %s in your role. Context so far: %s", F.size("frames"), listed, F.coalesce("context", F.lit("None")))
    return windows.withColumn("prompt", text)


#: Order of the three reports (fixed values).
ROLES = ("Biomechanist", "Referee", "Tactician")


def assemble_reports(reports: DataFrame) -> DataFrame:
    """(video_id, window_no, report): the roles' reports or failures in fixed order, joined by line feeds."""
    rank = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(ROLES)], F.lit(len(ROLES)))
    body = F.when(F.col("error").isNotNull(), F.format_string("--- %s FAILED ---\nError: %s\n", "role", "error")).otherwise(F.format_string("--- %s REPORT ---\n%s\n", "role", "text"))
    rows = reports.groupBy("video_id", "window_no").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("role").alias("role"), body.alias("body")))).alias("r"))
    return rows.select("video_id", "window_no", F.array_join(F.transform("r", lambda x: x["body"]), "\n").alias("report"))
