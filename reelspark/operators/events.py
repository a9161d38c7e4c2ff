"""Event messages of a video, and what a consumer makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.columns import frame_to_timestamp, stable_id
from reelspark.operators import scan
from reelspark.schemas import COMPLETION_BODY, EVENT_BODY

EVENT, COMPLETE = "bjj_event_detected", "analysis_complete"


def clip_to_event(clips: DataFrame, pieces: int | None = None) -> DataFrame:
    """video_id, event_index, total_events, times and one candidate's fields per clip, with defaults for what is missing.

    Needs video_id, clip_no, fps and the clip's fields; event_index is the clip's place, from 1. With `pieces` clips are numbered by
    ranges (`scan.numbered`), so that a video with most of all clips is not one task.
    """
    w = Window.partitionBy("video_id")
    c = F.col
    if pieces:
        total = clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_events"))
        clips = scan.numbered(clips, ("clip_no",), pieces, "event_index").join(total, "video_id")
    else:
        clips = clips.withColumns({"event_index": F.row_number().over(w.orderBy("clip_no")), "total_events": F.count(F.lit(1)).over(w)})
    return clips.select(
        "video_id",
        c("event_index").cast("long").alias("event_index"),
        "total_events",
        frame_to_timestamp(F.coalesce("start_frame", F.lit(0)), F.coalesce("fps", F.lit(0.0))).alias("start_time"),
        frame_to_timestamp(F.coalesce("end_frame", F.lit(0)), F.coalesce("fps", F.lit(0.0))).alias("end_time"),
        F.coalesce(c("role"), F.lit("Unknown")).alias("role"),
        F.coalesce(c("specific_technique"), F.lit("Unknown")).alias("skill_name"),
        F.coalesce(c("category"), F.lit("UNKNOWN")).alias("category"),
        F.coalesce(c("confidence"), F.lit(0.0)).alias("confidence"),
    )


def event_ids(events: DataFrame) -> DataFrame:
    """Ids that a retried task makes again: of the event, and of its candidate."""
    return events.withColumns({"id": stable_id(F.col("video_id"), F.col("event_index")), "candidate_id": stable_id(F.col("video_id"), F.col("event_index"), F.lit("c"))})


def _event_parts() -> tuple[Column, Column]:
    """Body and attributes of an event's message."""
    candidate = F.struct(F.col("candidate_id").alias("id"), "role", "skill_name", "category", "confidence")
    body = F.to_json(F.struct("id", F.col("video_id").cast("string").alias("video_id"), "start_time", "end_time", F.array(candidate).alias("event_candidates")))
    names = F.array(*[F.lit(x) for x in ("category", "event_type", "event_index", "total_events")])
    values = F.array("category", F.lit(EVENT), F.col("event_index").cast("string"), F.col("total_events").cast("string"))
    return body, F.map_from_arrays(names, values)


def _completion_parts(total: Column, job: Column | None, uri: Column | None) -> tuple[Column, Column]:
    """Body and attributes of a completion marker; the total stands in the body only, an empty URI is null."""
    job = F.col("video_id").cast("string") if job is None else job
    uri = F.lit(None).cast("string") if uri is None else F.nullif(uri, F.lit(""))
    body = F.struct(F.col("video_id").cast("string").alias("video_id"), job.alias("job_id"), total.cast("int").alias("total_event_count"), uri.alias("result_s3_uri"))
    return F.to_json(body, {"ignoreNullFields": "false"}), F.map_from_arrays(F.array(F.lit("event_type")), F.array(F.lit(COMPLETE)))


def event_messages(events: DataFrame) -> DataFrame:
    """(video_id, seq, body, attributes) of each event; numbers in attributes are text."""
    body, attributes = _event_parts()
    return events.select("video_id", F.col("event_index").alias("seq"), body.alias("body"), attributes.alias("attributes"))


def completion_messages(videos: DataFrame, events: DataFrame, job: Column | None = None, uri: Column | None = None) -> DataFrame:
    """One completion marker per video, those without events included; an empty URI is null."""
    n = events.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    rows = videos.join(n, "video_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    body, attributes = _completion_parts(F.col("n"), job, uri)
    return rows.select("video_id", (F.col("n") + 1).cast("long").alias("seq"), body.alias("body"), attributes.alias("attributes"))


def all_messages(videos: DataFrame, events: DataFrame, job: Column | None = None, uri: Column | None = None) -> DataFrame:
    """N event messages and then one completion marker for each video, from one pass over the events.

    The marker goes with the last event, whose index is the total, or with a video without events.
    `job` and `uri` are expressions over the columns of `videos`.
    """
    total = F.coalesce("total_events", F.lit(0))
    rows = videos.join(events, "video_id", "left")
    message = lambda seq, parts: F.struct(seq.cast("long").alias("seq"), parts[0].alias("body"), parts[1].alias("attributes"))
    event = F.when(F.col("event_index").isNotNull(), message(F.col("event_index"), _event_parts()))
    done = F.when(F.col("event_index").isNull() | (F.col("event_index") == F.col("total_events")), message(total + 1, _completion_parts(total, job, uri)))
    return rows.select("video_id", F.explode(F.filter(F.array(event, done), lambda m: m.isNotNull())).alias("m")).select("video_id", "m.*")


def enveloped(messages: DataFrame, at: Column | None = None) -> DataFrame:
    """(value): each message as the JSON text of the envelope in which a subscriber gets it."""
    key = stable_id(F.col("video_id"), F.col("seq"), F.lit("m"))
    attributes = F.transform_values("attributes", lambda k, v: F.struct(F.lit("String").alias("Type"), v.alias("Value")))
    at = F.lit(None).cast("timestamp") if at is None else at
    envelope = F.struct(F.lit("Notification").alias("Type"), key.alias("MessageId"), F.lit("events").alias("TopicArn"), F.col("body").alias("Message"), attributes.alias("MessageAttributes"), at.alias("Timestamp"))
    return messages.select(F.to_json(envelope).alias("value"))


def parse_envelope(feed: DataFrame) -> DataFrame:
    """Envelope and the JSON within its Message as typed columns; works on batches and streams.

    total_events is the attribute of an event message, and of a completion marker the total in its body.
    """
    attr = lambda k: F.element_at("MessageAttributes", k)["Value"]
    event, done = F.from_json("Message", EVENT_BODY), F.from_json("Message", COMPLETION_BODY)
    kind = attr("event_type")
    return feed.select(
        "MessageId",
        "Timestamp",
        F.col("MessageAttributes").alias("attributes"),
        kind.alias("event_type"),
        attr("event_index").cast("long").alias("event_index"),
        F.coalesce(attr("total_events").cast("long"), F.when(kind == COMPLETE, done["total_event_count"]).cast("long")).alias("total_events"),
        attr("category").alias("category"),
        F.coalesce(event["video_id"], done["video_id"]).alias("video_id"),
        F.when(kind == EVENT, event).alias("event"),
        F.when(kind == COMPLETE, done).alias("completion"),
    )


def policy_condition(policy: dict, attribute) -> Column:
    """All attributes must match (AND), each by any of its values (OR); {"exists": False} matches a missing one."""
    out = F.lit(True)
    for name, rules in policy.items():
        value, any_of = attribute(name), F.lit(False)
        for rule in rules if isinstance(rules, list) else [rules]:
            if isinstance(rule, dict) and "exists" in rule:
                any_of = any_of | (value.isNotNull() if rule["exists"] else value.isNull())
            else:
                any_of = any_of | F.coalesce(value == str(rule), F.lit(False))
        out = out & any_of
    return out


def filter_policy(msgs: DataFrame, policy: dict) -> DataFrame:
    """Messages whose attributes (a map column, or columns of that name) match the policy."""
    if "attributes" in msgs.columns:
        kind = dict(msgs.dtypes)["attributes"]
        get = lambda k: F.element_at("attributes", k)["Value"] if "struct" in kind else F.element_at("attributes", k)
    else:
        get = lambda k: F.col(k).cast("string")
    return msgs.where(policy_condition(policy, get))


def dedupe_messages(msgs: DataFrame, key: tuple[str, ...] = ("id",), watermark: tuple[str, str] | None = None) -> DataFrame:
    """One of the messages with equal keys; a stream needs a watermark (column, delay), which bounds its state."""
    if msgs.isStreaming:
        column, delay = watermark or ("Timestamp", "1 day")
        return msgs.withWatermark(column, delay).dropDuplicatesWithinWatermark(list(key))
    return msgs.dropDuplicates(list(key))


def upsert_events(msgs: DataFrame, key: tuple[str, ...] = ("video_id", "event_index"), order: tuple[str, ...] = ("Timestamp", "MessageId")) -> DataFrame:
    """The latest version per key: the row with the largest values of `order`."""
    rest = [c for c in msgs.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("s")
    return msgs.groupBy(*key).agg(best).select(*key, "s.*").select(msgs.columns)


def video_status(msgs: DataFrame, by: tuple[str, ...] = ("video_id",), unique: bool = False) -> DataFrame:
    """Per video: received_count (different events), completion_received, expected_total; job_id and result_s3_uri
    where `msgs` has completion (of parsed envelopes), created_at and updated_at where it has Timestamp.

    A set of indices is counted, so that repeated deliveries change nothing, on a stream as well; `unique` says that none is repeated.
    `by` may have columns besides video_id that a video decides.
    """
    done = F.col("event_type") == COMPLETE
    index = F.when(F.col("event_type") == EVENT, F.col("event_index"))
    if unique:
        received = F.count(index)
    elif msgs.isStreaming:
        received = F.size(F.collect_set(index))
    else:
        received = F.count_distinct(index)
    more = []
    if "completion" in msgs.columns:
        more += [F.max(f"completion.{c}").alias(c) for c in ("job_id", "result_s3_uri")]
    if "Timestamp" in msgs.columns:
        more += [F.min("Timestamp").alias("created_at"), F.max("Timestamp").alias("updated_at")]
    return msgs.groupBy(*by).agg(
        received.cast("long").alias("received_count"),
        F.bool_or(done).alias("completion_received"),
        F.coalesce(F.max(F.when(done, F.col("total_events"))), F.max("total_events")).cast("long").alias("expected_total"),
        *more,
    )


def finalise(status: DataFrame) -> DataFrame:
    """Videos of which every event and the completion marker have come, in whatever order."""
    return status.where("completion_received and received_count >= expected_total")
