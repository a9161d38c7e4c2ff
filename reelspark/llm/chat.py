"""Chat formatting by perspective rotation, from DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import stored

#: Turns of one chunk by their number, and rows of a chunk beyond which it is cut further, in order.
CHUNK_TURNS, CHUNK_ROWS = 256, 1024


def _cut(rows: DataFrame, n: int) -> DataFrame:
    """`rows` (about n, all different) with slot: CHUNK_ROWS of a chunk to each in the order of turn, role and text, the last with the rest.

    Rows are sorted into ranges, counted by range and numbered within it, so no task holds a whole chunk.
    """
    order, chunk = ["turn", "role", "text"], ["conv_id", "chunk"]
    ranges = rows.repartitionByRange(-(-n // (4 * CHUNK_ROWS)), *chunk, *order).withColumn("range", F.spark_partition_id())
    ranges = stored(ranges, "chat-ranges")
    sizes = ranges.groupBy("range", *chunk).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*chunk).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranges.withColumn("place", F.row_number().over(Window.partitionBy("range", *chunk).orderBy(*order)) - 1)
    placed = numbered.join(sizes.withColumn("before", before).drop("count"), ["range", *chunk])
    return placed.withColumn("slot", F.floor((F.col("before") + F.col("place")) / CHUNK_ROWS).cast("int")).select(*rows.columns, "slot")


def rotated_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation rendered once for every participant: that speaker as assistant, all others as named users.

    Returns conv_id, speaker, chunk, slot, n_turns, n_own, text and mask. A turn is written as
    `<|assistant|>`, or `<|user name=NAME|>` for the others, a line feed, its text, `<|end|>` and a line
    feed; "<|" in a name or text becomes "< |", so that no text can forge a turn. mask lists the character
    spans start-end (end excluded, from 0 within the row's text) of the speaker's own texts with their
    `<|end|>`, joined by commas: the tokens to learn.

    Turns are ordered by number, then name, then text; rows that repeat all four columns count once. A
    null name is "unknown", a null text empty, a null turn comes first (chunk -1); rows without a
    conversation are left out. A conversation is cut into chunks of 256 turn numbers, to be read in the
    order of chunk and slot, so that a conversation of a third of all rows is many rows: slot is 0 but
    where over 1024 different rows share a chunk, which is cut after each 1024 of them in that order. No rows give no rows; other columns are ignored.
    The result has each turn once for every speaker of its conversation, as the method wants: it grows with their product.
    """
    name = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), name.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.distinct().withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-1)).cast("long"))
    full = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK_ROWS)
    full = stored(full, "chat-full")
    slotted, n = rows.withColumn("slot", F.lit(0)), full.agg(F.sum("n")).first()[0]
    if n:
        slotted = slotted.join(full, ["conv_id", "chunk"], "left_anti").unionByName(_cut(rows.join(full, ["conv_id", "chunk"], "left_semi"), n))
    chunks = slotted.groupBy("conv_id", "chunk", "slot").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = rows.select("conv_id", F.col("role").alias("speaker")).distinct()

    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), safe(t["role"]), F.lit("|>\n")))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(safe(t["text"]), F.lit("<|end|>")).alias("body"), own(t).alias("own")))
    step = lambda s, p: F.struct(
        (s["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
        F.when(
            p["own"],
            F.concat(s["mask"], F.array(F.concat((s["at"] + F.length(p["head"])).cast("string"), F.lit("-"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string")))),
        )
        .otherwise(s["mask"])
        .alias("mask"),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask"))
    chats = chunks.join(speakers, "conv_id").withColumn("parts", parts)
    return chats.select(
        "conv_id",
        "speaker",
        "chunk",
        "slot",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.aggregate("parts", begin, step)["mask"], ",").alias("mask"),
    )
