"""Scans in a video's order that no single task has to make: a table is cut into ranges, and each knows what came before.

Rows are dealt by ranges of (video, order), so a video with most of all rows lies in many pieces. What a piece gives
on - its number of rows, its last category, the largest end so far - is one row. A cut lies within one
video at most, so fewer of these rows than pieces are needed, and only they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.sources.tables import scratch

KEY = ("video_id", "piece")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """`rows` as a table in the shared folder: cuts stay where they are, and nothing is computed twice."""
    path = scratch(rows.sparkSession, f"scan-{name}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, order: tuple[str, ...], pieces: int) -> DataFrame:
    """`rows` with piece, the number of their range, rows with equal keys in one; a table."""
    return kept(rows.repartitionByRange(pieces, "video_id", *order).withColumn("piece", F.spark_partition_id()), "dealt")


def before(rows: DataFrame, sums: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """(video_id, piece, the names of `carry`): for each piece of a video but its first, from the aggregates `sums` of its pieces.

    The expressions of `carry` are evaluated over a window of the video's pieces in order, up to the one before.
    """
    of = rows.groupBy(*KEY).agg(*[v.alias(k) for k, v in sums.items()])
    cut = of.groupBy("video_id").agg(F.min("piece").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    earlier = Window.partitionBy("video_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = of.join(cut, "video_id").withColumns({k: v.over(earlier) for k, v in carry.items()})
    return rows.where("piece > first").select(*KEY, *carry)


def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """`rows` with the columns of `carry`, null in first pieces; `carry` has fewer rows than there are pieces."""
    return rows.join(F.broadcast(kept(carry, "carry")), list(KEY), "left")


def numbered(rows: DataFrame, order: tuple[str, ...], pieces: int, rn: str = "rn") -> DataFrame:
    """`rows` with their number within the video in `order`, from 1."""
    cut = dealt(rows, order, pieces)
    carry = before(cut, {"n": F.count(F.lit(1))}, {"n_before": F.sum("n")})
    local = cut.withColumn(rn, F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    return with_carry(local, carry).withColumn(rn, F.col(rn) + F.coalesce("n_before", F.lit(0))).drop("piece", "n_before")


def islands(clips: DataFrame, gap: int, pieces: int) -> DataFrame:
    """`clips` with rank, their number by start_frame and pos, and island, the number of the merged clip they belong to."""
    order = ("start_frame", "pos")
    w = Window.partitionBy(*KEY).orderBy(*order)
    cut = dealt(clips, order, pieces)
    place = F.struct(*order)
    carry = before(cut, {"n": F.count(F.lit(1)), "category": F.max_by(F.struct("category"), place)}, {"n_before": F.sum("n"), "category_before": F.last("category")})
    rows = cut.withColumns({"nth": F.row_number().over(w), "lag": F.lag(F.struct("category")).over(w)})
    rows = with_carry(rows, carry)
    rows = rows.withColumns({"lag": F.coalesce("lag", "category_before"), "rank": F.col("nth") + F.coalesce("n_before", F.lit(0))})
    change = F.when(F.col("lag").isNotNull() & F.col("category").eqNullSafe(F.col("lag.category")), 0).otherwise(1)
    rows = rows.withColumn("change", change).drop("nth", "lag", "n_before", "category_before")
    # runs of one category; number 0 within a piece is the run that the pieces before began
    by_rank = Window.partitionBy(*KEY).orderBy("rank")
    rows = kept(rows.withColumn("run", F.sum("change").over(by_rank)), "runs")
    earlier = Window.partitionBy(*KEY, "run").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prev", F.max("end_frame").over(earlier))
    # largest end of the run that a piece ends with: of those of its own, or on from earlier pieces if it begins none
    last = F.max_by(F.struct("run"), F.col("rank"))["run"]
    of = rows.groupBy(*KEY).agg(last.alias("runs"))
    ends = rows.join(of, list(KEY)).where("run = runs").groupBy(*KEY).agg(F.first("runs").alias("runs"), F.max("end_frame").alias("end"))
    pieces_of = Window.partitionBy("video_id").orderBy("piece")
    ends = ends.withColumn("begun", F.sum("runs").over(pieces_of))
    ends = ends.withColumn("so_far", F.max("end").over(Window.partitionBy("video_id", "begun").orderBy("piece")))
    ends = ends.withColumn("end_before", F.lag("so_far").over(pieces_of))
    tail = ends.where("end_before is not null").select(*KEY, "end_before")
    rows = with_carry(rows, tail)
    prev = F.when(F.col("run") == 0, F.greatest("prev", "end_before")).otherwise(F.col("prev"))
    breaks = F.when(prev.isNull() | (F.col("start_frame") - prev >= gap), 1).otherwise(0)
    rows = kept(rows.withColumn("breaks", breaks).drop("prev", "end_before", "run", "change"), "breaks")
    carry = before(rows, {"n": F.sum("breaks")}, {"n_before": F.sum("n")})
    rows = with_carry(rows.withColumn("island", F.sum("breaks").over(by_rank)), carry)
    return rows.withColumn("island", F.col("island") + F.coalesce("n_before", F.lit(0))).drop("piece", "breaks", "n_before")
