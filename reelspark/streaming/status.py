"""Status of each video, kept up to date from an at-least-once, unordered stream of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators.events import finalise, upsert_events, video_status
from reelspark.sources.commits import Conflict, Versions

#: Messages of a part at most, on average; a part that grows beyond is split in two by the next bit of the video's hash.
PART_ROWS = 1 << 15
KEY = ("video_id", "event_type", "event_index")
COLUMNS = (*KEY, "total_events", "completion", "Timestamp", "MessageId")
#: Times that a batch is merged anew because another writer came first.
TRIES = 5


def _hash() -> Column:
    return F.xxhash64("video_id").bitwiseAND(F.lit((1 << 62) - 1))


def _name(depth: int) -> Column:
    """The part at `depth`: that number, and so many of the lowest bits of the video's hash."""
    return F.concat(F.lit(f"{depth}-"), F.pmod("hash", F.lit(1 << depth)).cast("string"))


def _part_of(names: list[str]) -> Column:
    """The part of each row among `names`, which share its hash values out among them.

    One look-up for each depth that occurs; depths differ by the logarithm of the sizes only.
    """
    by: dict[int, list[str]] = {}
    for n in names:
        by.setdefault(int(n.split("-")[0]), []).append(n)
    *others, last = sorted(by)
    out = _name(last)
    for d in others:
        out = F.when(_name(d).isin(by[d]), _name(d)).otherwise(out)
    return out


def _split(name: str, rows: int) -> list[str]:
    """The parts that take the place of a part with so many rows."""
    depth, bits = map(int, name.split("-"))
    more = max(0, (-(-rows // PART_ROWS) - 1).bit_length())
    return [f"{depth + more}-{bits + (i << depth)}" for i in range(1 << more)]


def _files(v: Versions, parts: dict, names: list[str], kind: str) -> list[str]:
    return [f"{v.path}/{parts[n][kind]}" for n in sorted(names) if parts[n]["rows"]]


def read_status(spark: SparkSession, path: str) -> DataFrame | None:
    """The status table as of the last batch, or None before the first."""
    v = Versions(spark, path)
    parts = v.newest()["parts"]
    files = _files(v, parts, list(parts), "status")
    return spark.read.parquet(*files) if files else None


def _staged(batch: DataFrame, v: Versions) -> tuple[DataFrame, str]:
    """The batch's messages, once each, in a folder of their own, so that the source is read once."""
    rows, folder = upsert_events(batch.select(*COLUMNS), KEY).withColumn("hash", _hash()), v.new_folder()
    rows.write.parquet(f"{v.path}/{folder}")
    return batch.sparkSession.read.schema(rows.schema).parquet(f"{v.path}/{folder}"), folder


def _merged(staged: DataFrame, v: Versions, base: dict) -> dict | None:
    """Write the touched parts anew, and give the parts of the next version; None if the batch is empty."""
    spark, parts = staged.sparkSession, base["parts"] or {"0-0": {"rows": 0}}
    came = {r["part"]: r["count"] for r in staged.select(_part_of(list(parts)).alias("part")).groupBy("part").count().collect()}  # a row for each part at most
    if not came:
        return None
    names = [n for p, k in came.items() for n in _split(p, k + parts[p]["rows"])]
    before = _files(v, parts, list(came), "messages")
    rows = upsert_events(spark.read.schema(staged.schema).parquet(*before).unionByName(staged), KEY) if before else staged
    folder = v.new_folder()
    rows = rows.withColumn("part", _part_of(names))
    rows.repartition("part").write.partitionBy("part").parquet(f"{v.path}/{folder}/messages")
    kept = spark.read.schema(rows.schema).parquet(f"{v.path}/{folder}/messages")
    # a part's messages are brought together once, for its videos' status and for its file
    state = video_status(kept.drop("hash").repartition("part"), ("part", "video_id"), unique=True)
    state = state.withColumn("finalized", F.coalesce(F.expr("completion_received and received_count >= expected_total"), F.lit(False)))
    state.write.partitionBy("part").parquet(f"{v.path}/{folder}/status")
    counts = {r["part"]: r["count"] for r in kept.groupBy("part").count().collect()}
    new = {n: {"rows": counts.get(n, 0)} | {k: f"{folder}/{k}/part={n}" for k in ("messages", "status") if n in counts} for n in names}
    return {n: p for n, p in parts.items() if n not in came} | new


def upsert_status(batch: DataFrame, batch_id: int, path: str) -> None:
    """For foreachBatch: add a batch's messages and bring the status of the videos it touches up to date.

    Messages are kept once per (video_id, event_type, event_index), the latest. They and the status are kept in parts of bounded size by the
    hash of the video, of which a batch reads and rewrites those of its videos. All parts change at once, by one numbered
    file that is renamed into place: a batch that breaks off anywhere changes nothing, one that runs twice
    changes nothing the second time, and one that another writer overtook is merged again. Files of old versions go
    after the next.
    """
    v = Versions(batch.sparkSession, path)
    staged, folder = _staged(batch, v)
    for turn in range(TRIES):
        base = v.newest()
        parts = _merged(staged, v, base)
        try:
            if parts is None:
                break
            v.commit(base, parts)
            break
        except Conflict:
            if turn + 1 == TRIES:
                raise
    v.remove([folder])
    v.clean()


def run_status_stream(messages: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what is there of a stream of parsed messages and stop; started again, it takes in what is new."""
    query = messages.writeStream.foreachBatch(lambda b, i: upsert_status(b, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


__all__ = ["finalise", "read_status", "run_status_stream", "upsert_status"]
