"""Model responses: fences, strict JSON, context carried from window to window, the raw log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.columns import col
from reelspark.schemas import ANALYSIS

FENCE = "```"
START_CONTEXT = "Start of match."


def strip_fences(text: Column | str) -> Column:
    """What stands in the first json fence, else in the first fence, else all; without white space around it."""
    t, fence = col(text), F.lit(FENCE)
    within = lambda mark: F.split_part(F.split_part(t, F.lit(mark), F.lit(2)), fence, F.lit(1))
    inner = F.when(F.contains(t, F.lit(FENCE + "json")), F.split_part(F.substring(t, F.instr(t, FENCE + "json") + len(FENCE + "json"), F.length(t)), fence, F.lit(1)))
    inner = inner.when(F.contains(t, fence), within(FENCE)).otherwise(t)
    return F.regexp_replace(F.regexp_replace(inner, r"^\s+", ""), r"\s+$", "")


def parse_responses(windows: DataFrame) -> DataFrame:
    """Adds body, parse_ok, analysis (null if bad) and raw_error (the response, if bad).

    Only one JSON object without anything after it is good. A bad final window is dropped, other bad
    ones stay in the log.
    """
    body = windows.withColumn("body", strip_fences("response"))
    one = F.from_json(F.concat(F.lit("["), F.col("body"), F.lit("]")), f"array<{ANALYSIS}>", {"allowSingleQuotes": "false"})
    keys = F.json_object_keys("body")
    rows = body.withColumns({"many": one, "keys": keys})
    rows = rows.withColumn("parse_ok", F.coalesce((F.size("many") == 1) & F.get("many", F.lit(0)).isNotNull() & F.col("keys").isNotNull() & F.startswith("body", F.lit("{")) & F.endswith("body", F.lit("}")), F.lit(False)))
    rows = rows.withColumns({"analysis": F.when(F.col("parse_ok"), F.get("many", F.lit(0))), "raw_error": F.when(~F.col("parse_ok"), F.col("response"))})
    return rows.where("parse_ok or not is_final").drop("many")


def carry_context(parsed: DataFrame) -> DataFrame:
    """context of each window: the summary of the latest earlier window whose answer has that key, even if null."""
    has = F.col("parse_ok") & F.array_contains("keys", "current_context_summary")
    before = Window.partitionBy("video_id").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(has, F.struct(F.col("analysis.current_context_summary").alias("summary"))), ignorenulls=True).over(before)
    return parsed.withColumn("last", last).withColumn("context", F.when(F.col("last").isNull(), F.lit(START_CONTEXT)).otherwise(F.col("last.summary"))).drop("last")


def raw_records(parsed: DataFrame) -> DataFrame:
    """Rows of the raw log: window, frames and analysis, or window and raw_error.

    analysis_json is the analysis as the model wrote it, with all its keys, nulls and values of other types than expected;
    analysis has the fields that operators use.
    """
    window = F.when(F.col("is_final"), "final").otherwise(F.col("window_no").cast("string"))
    frames = F.when(F.col("parse_ok"), F.col("frames")) if "frames" in parsed.columns else F.lit(None).cast("array<bigint>")
    text = F.when(F.col("parse_ok"), F.col("body"))
    return parsed.select("video_id", "window_no", "is_final", window.alias("window"), frames.alias("frames"), "analysis", text.alias("analysis_json"), "raw_error")
