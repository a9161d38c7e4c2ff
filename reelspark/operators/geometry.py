"""Boxes, crops, output sizes and tiles. The order of floating-point operations decides truncated results; keep it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_box(df: DataFrame) -> DataFrame:
    """Per frame the box around all athletes' boxes, computed within the row; frames without boxes have none."""
    side = lambda f, i: f(F.transform("athletes", lambda a: F.get(a["box"], F.lit(i))))
    boxes = df.where(F.size("athletes") > 0).withColumns({"x1": side(F.array_min, 0), "y1": side(F.array_min, 1), "x2": side(F.array_max, 2), "y2": side(F.array_max, 3)})
    return boxes.where("x1 is not null").drop("athletes")


def square_crop(df: DataFrame, padding: float = 0.2, bounded: bool = True) -> DataFrame:
    """Padded square around a box: moved into the image right, down, left, up, then truncated and clamped.

    Needs width and height unless `bounded` is False; then edges are only truncated. A square larger than
    the image ends up clamped and not square.
    """
    c = F.col
    side = F.greatest(c("x2") - c("x1"), c("y2") - c("y1")) * (1 + padding)
    out = df.withColumn("side", side).withColumn("cx", c("x1") + (c("x2") - c("x1")) / 2).withColumn("cy", c("y1") + (c("y2") - c("y1")) / 2)
    half = c("side") / 2
    out = out.withColumns({"l": c("cx") - half, "t": c("cy") - half, "r": c("cx") + half, "b": c("cy") + half})
    if bounded:
        out = out.withColumns({"r": F.when(c("l") < 0, c("r") - c("l")).otherwise(c("r")), "l": F.when(c("l") < 0, 0.0).otherwise(c("l"))})
        out = out.withColumns({"b": F.when(c("t") < 0, c("b") - c("t")).otherwise(c("b")), "t": F.when(c("t") < 0, 0.0).otherwise(c("t"))})
        out = out.withColumns({"l": F.when(c("r") > c("width"), c("l") - (c("r") - c("width"))).otherwise(c("l")), "r": F.when(c("r") > c("width"), c("width").cast("double")).otherwise(c("r"))})
        out = out.withColumns({"t": F.when(c("b") > c("height"), c("t") - (c("b") - c("height"))).otherwise(c("t")), "b": F.when(c("b") > c("height"), c("height").cast("double")).otherwise(c("b"))})
        clamp = lambda v, m: F.greatest(F.lit(0), F.least(c(m).cast("int"), c(v).cast("int")))
        out = out.withColumns({"crop_x1": clamp("l", "width"), "crop_y1": clamp("t", "height"), "crop_x2": clamp("r", "width"), "crop_y2": clamp("b", "height")})
    else:
        out = out.withColumns({f"crop_{k}": c(v).cast("int") for k, v in (("x1", "l"), ("y1", "t"), ("x2", "r"), ("y2", "b"))})
    return out.drop("side", "cx", "cy", "l", "t", "r", "b")


def valid_crop(df: DataFrame) -> DataFrame:
    return df.where("crop_x2 > crop_x1 and crop_y2 > crop_y1")


def enhance_plan(df: DataFrame, method: str | None = "esrgan", target_size: int = 1024, model_scale: int = 4) -> DataFrame:
    """out_w, out_h of each crop by `method`, or by a column of that name if it is None; a diffusion side that falls to 0 fails the frame, whose row is dropped."""
    c = F.col
    w, h = c("crop_x2") - c("crop_x1"), c("crop_y2") - c("crop_y1")
    diffusion = c("method") == "diffusion" if method is None else F.lit(method == "diffusion")
    small, big = F.greatest(w, h), F.greatest(w * model_scale, h * model_scale)
    eighths = lambda v: F.floor(F.when(small > 768, (v * (F.lit(768.0) / small)).cast("int")).otherwise(v) / 8).cast("int") * 8
    scaled = lambda v: F.when(big > target_size, (v * model_scale * (F.lit(float(target_size)) / big)).cast("int")).otherwise(v * model_scale)
    out = df.withColumns({f"out_{n}": F.when(diffusion, eighths(v)).otherwise(scaled(v)) for n, v in (("w", w), ("h", h))})
    return out.where(~diffusion | ((c("out_w") > 0) & (c("out_h") > 0)))


def crop_path(df: DataFrame, method: str, out_dir: str) -> DataFrame:
    """Path of each enhanced crop; unknown methods are named like the default one."""
    prefix = {"diffusion": "diff_", "swinir": "swinir_", "hat": "hat_"}.get(method, "esrgan_")
    return df.withColumn("path", F.format_string("%s/%sframe_%06d.jpg", F.lit(out_dir), F.lit(prefix), F.col("frame")))


def clamp_box(df: DataFrame) -> DataFrame:
    """Corners truncated to integers and clamped to the image."""
    within = lambda v, m: F.least(F.col(m), F.greatest(F.lit(0), F.col(v).cast("int")))
    return df.withColumns({"x1": within("x1", "width"), "y1": within("y1", "height"), "x2": within("x2", "width"), "y2": within("y2", "height")})


def roi_to_box(df: DataFrame) -> DataFrame:
    """(x, y, w, h) as corners; four zeros mean that the choice was cancelled."""
    rows = df.where("not (x = 0 and y = 0 and w = 0 and h = 0)")
    return rows.withColumn("box", F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))).drop("x", "y", "w", "h")


def mask_bbox(pixels: DataFrame) -> DataFrame:
    """Inclusive box and area of each mask's set pixels; an empty mask has no row."""
    return pixels.groupBy("video_id", "frame", "track_id").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("mask_area")
    )


def mask_runs(pixels: DataFrame, width: int) -> DataFrame:
    """Masks as runs (video_id, frame, track_id, width, starts, lengths) from a row per set pixel (x, y), counted row by row from 0.

    Pixels that repeat count once; a pixel outside of its row is an error of the input and stays out. One shuffle of sets of
    pixels, and runs are told within a mask's row, so that a task holds its pixels once, in a sorter that spills.
    """
    keys = ("video_id", "frame", "track_id")
    at = F.sort_array(F.collect_set((F.col("y") * width + F.col("x")).cast("long")))
    rows = pixels.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0)).groupBy(*keys).agg(at.alias("at"))
    # a run starts and ends where no neighbour is set
    edges = lambda step: F.filter("at", lambda p, i: F.coalesce(F.get("at", i + step) != p + step, F.lit(True)))
    rows = rows.select(*keys, edges(-1).alias("starts"), edges(1).alias("ends"))
    return rows.select(*keys, F.lit(width).alias("width"), "starts", F.zip_with("starts", "ends", lambda s, e: e - s + 1).alias("lengths"))


def mask_bbox_runs(masks: DataFrame) -> DataFrame:
    """As mask_bbox from masks as runs (starts, lengths, width): box and area within the row, without a shuffle.

    A run that goes on in the next row touches both sides of the image. Runs without length don't count; those of
    a mask mustn't overlap.
    """
    runs = F.filter(F.arrays_zip(F.col("starts").alias("starts"), F.col("lengths").alias("lengths")), lambda r: r["lengths"] > 0)
    width, end = F.col("width"), lambda r: r["starts"] + r["lengths"] - 1
    row = lambda at: F.floor(at / width)
    wraps = lambda r: row(r["starts"]) != row(end(r))
    rows = masks.withColumn("runs", runs).where("size(runs) > 0")
    of = lambda f: F.transform("runs", f)
    box = {
        "x1": F.array_min(of(lambda r: F.when(wraps(r), 0).otherwise(F.pmod(r["starts"], width)))),
        "y1": F.array_min(of(lambda r: row(r["starts"]))),
        "x2": F.array_max(of(lambda r: F.when(wraps(r), width - 1).otherwise(F.pmod(end(r), width)))),
        "y2": F.array_max(of(lambda r: row(end(r)))),
        "mask_area": F.aggregate(of(lambda r: r["lengths"].cast("long")), F.lit(0).cast("long"), lambda s, n: s + n),
    }
    return rows.select("video_id", "frame", "track_id", *[v.cast("long").alias(k) for k, v in box.items()])


def tile_plan(images: DataFrame, tile: int = 400, pad: int = 10, scale: int = 4) -> DataFrame:
    """One row per tile: input bounds, padded bounds, output bounds and the offset of the tile in its padded output.

    An image that fits into one tile is one row without padding, as is every image with tile 0.
    """
    c = F.col
    tiled = (F.lit(tile) > 0) & ((c("height") > tile) | (c("width") > tile))
    step = F.when(tiled, F.lit(max(tile, 1))).otherwise(F.greatest("width", "height", F.lit(1)))
    rows = images.withColumns({"tw": step, "p": F.when(tiled, F.lit(pad)).otherwise(F.lit(0))})
    last = lambda side: F.greatest(F.ceil(c(side) / c("tw")).cast("int") - 1, F.lit(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last("height"))).alias("tile_y")).select("*", F.explode(F.sequence(F.lit(0), last("width"))).alias("tile_x"))
    rows = rows.withColumns({"x1": c("tile_x") * c("tw"), "y1": c("tile_y") * c("tw")})
    rows = rows.withColumns({"x2": F.least(c("x1") + c("tw"), "width"), "y2": F.least(c("y1") + c("tw"), "height")})
    rows = rows.withColumns(
        {
            "pad_x1": F.greatest(c("x1") - c("p"), F.lit(0)),
            "pad_y1": F.greatest(c("y1") - c("p"), F.lit(0)),
            "pad_x2": F.least(c("x2") + c("p"), "width"),
            "pad_y2": F.least(c("y2") + c("p"), "height"),
        }
    )
    rows = rows.withColumns({f"out_{k}": c(k) * scale for k in ("x1", "y1", "x2", "y2")})
    return rows.withColumns({"in_x": (c("x1") - c("pad_x1")) * scale, "in_y": (c("y1") - c("pad_y1")) * scale}).drop("tw", "p")
