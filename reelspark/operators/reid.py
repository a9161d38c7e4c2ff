"""Identity re-matching by appearance: embeddings and colour histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.columns import appearance_score

#: Entries of a block of a video's gallery, and candidates of a block, on average.
GALLERY_BLOCK, CANDIDATE_BLOCK = 256, 1 << 16


def hs_histogram(pixels: DataFrame, keys: tuple[str, ...] = ("video_id", "frame", "cand_idx")) -> DataFrame:
    """8 hue by 4 saturation bins, flattened hue-major and scaled to 0..1 (all equal: 0); pixels out of range don't count."""
    rows = pixels.where("h >= 0 and h < 180 and s >= 0 and s < 256")
    rows = rows.withColumn("bin", (F.floor(F.col("h") / 22.5) * 4 + F.floor(F.col("s") / 64)).cast("int"))
    n = rows.groupBy(*keys, "bin").count().groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("count").cast("double")))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    low, high = F.array_min("v"), F.array_max("v")
    scaled = F.transform("v", lambda x: F.when(F.col("high") > F.col("low"), (x - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0))
    return n.withColumn("v", full).withColumns({"low": low, "high": high}).select(*keys, scaled.alias("histogram"))


def build_gallery(appearance: DataFrame, order: str = "seq") -> DataFrame:
    """One entry per video and track: the last by input order; null features are allowed."""
    rest = [c for c in appearance.columns if c not in ("video_id", "track_id")]
    best = F.max_by(F.struct(*rest), order).alias("s")
    return appearance.groupBy("video_id", "track_id").agg(best).select("video_id", "track_id", "s.*").drop(order)


def in_blocks(cands: DataFrame, gallery: DataFrame, entry: tuple[str, ...], entries: int = GALLERY_BLOCK, rows: int = CANDIDATE_BLOCK) -> DataFrame:
    """Every gallery entry of a video beside each of its candidates: the columns of `cands`, and `entry` of the gallery as g.

    A video's entries are packed into blocks of about `entries`, its candidates into blocks of about `rows`, both by counts; a block of candidates
    meets each block of entries in a task of its own. So neither a large gallery nor a video with most of all candidates
    makes a large task, and nothing is broadcast but what turns out small when it has been made.
    """
    n = cands.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n"))
    m = gallery.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / entries).cast("int").alias("m"))
    size = n.join(m, "video_id")
    deal = lambda c: F.pmod(F.xxhash64("track_id"), F.col(c)).cast("int")
    packed = gallery.join(size, "video_id").withColumn("block", deal("m")).groupBy("video_id", "block", "n").agg(F.collect_list(F.struct(*entry)).alias("entries"))
    packed = packed.select("video_id", "block", "entries", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    dealt = cands.join(size, "video_id").withColumn("salt", F.pmod(F.xxhash64("frame", "cand_idx"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).drop("n", "m")
    return dealt.join(packed, ["video_id", "block", "salt"]).drop("block", "salt").withColumn("g", F.explode("entries")).drop("entries")


def score_matrix(cands: DataFrame, gallery: DataFrame) -> DataFrame:
    """Every gallery entry of a video against each of its candidates: (video_id, frame, cand_idx, track_id, score)."""
    rows = in_blocks(cands.select("video_id", "frame", "cand_idx", "features", "histogram"), gallery, ("track_id", "features", "histogram"))
    return rows.select("video_id", "frame", "cand_idx", "g.track_id", appearance_score("features", "histogram", "g.features", "g.histogram").alias("score"))


def greedy_assign(scores: DataFrame, cands: DataFrame, min_score: float = 0.4) -> DataFrame:
    """Per frame: best pairs first (ties: smaller track, then candidate), each side once, only above `min_score`.

    Returns every candidate with track_id and score, or -1 and 0.0. The fold runs over one frame's pairs
    that can be taken at all.
    """
    item = F.struct((-F.col("score")).alias("neg"), "track_id", "cand_idx")
    pairs = scores.where(F.col("score") > min_score).groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    kind = dict(scores.dtypes)
    taken = f"array<struct<track_id: {kind['track_id']}, cand_idx: {kind['cand_idx']}, score: double>>"
    step = lambda out, p: F.when(
        F.exists(out, lambda o: (o["track_id"] == p["track_id"]) | (o["cand_idx"] == p["cand_idx"])), out
    ).otherwise(F.concat(out, F.array(F.struct(p["track_id"].alias("track_id"), p["cand_idx"].alias("cand_idx"), (-p["neg"]).alias("score")))))
    chosen = pairs.select("video_id", "frame", F.explode(F.aggregate("pairs", F.array().cast(taken), step)).alias("o")).select("video_id", "frame", "o.*")
    rows = cands.select("video_id", "frame", "cand_idx").join(chosen, ["video_id", "frame", "cand_idx"], "left")
    return rows.select("video_id", "frame", "cand_idx", F.coalesce("track_id", F.lit(-1)).alias("track_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def detect_swaps(boxes: DataFrame, gallery: DataFrame) -> DataFrame:
    """(video_id, frame, a, b, swapped) of the two smallest tracks a < b of each frame.

    swapped: each looks more like the other's gallery entry than like its own. Frames with fewer than two
    boxes and videos with fewer than two gallery entries give no row; a missing entry scores 0.
    """
    w = Window.partitionBy("video_id", "frame").orderBy("track_id")
    two = boxes.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    frames = two.groupBy("video_id", "frame").agg(
        *[F.max(F.when(F.col("rn") == i, F.col(c))).alias(f"{p}{n}") for i, n in ((1, "a"), (2, "b")) for c, p in (("track_id", "t"),)],
        *[F.max_by(F.struct("features", "histogram"), F.when(F.col("rn") == i, F.lit(1))).alias(f"v{n}") for i, n in ((1, "a"), (2, "b"))],
        F.count(F.lit(1)).alias("n"),
    )
    frames = frames.where("n = 2").drop("n")
    many = gallery.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("video_id")
    frames = frames.join(many, "video_id", "left_semi")
    g = gallery.select("video_id", "track_id", F.struct("features", "histogram").alias("g"))
    for n in ("a", "b"):
        frames = frames.join(g.withColumnsRenamed({"track_id": f"t{n}", "g": f"g{n}"}), ["video_id", f"t{n}"], "left")
    score = lambda x, y: F.when(F.col(f"g{y}").isNull(), 0.0).otherwise(appearance_score(F.col(f"v{x}.features"), F.col(f"v{x}.histogram"), F.col(f"g{y}.features"), F.col(f"g{y}.histogram")))
    swapped = (score("a", "b") > score("a", "a")) & (score("b", "a") > score("b", "b"))
    return frames.select("video_id", "frame", F.col("ta").alias("a"), F.col("tb").alias("b"), swapped.alias("swapped"))
