"""Job requests and job states as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.schemas import REQUEST_FIELDS, REQUIRED

_DASHED = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: With and without hyphens, in braces, or as a URN.
UUID = rf"^(?i)(?:[0-9a-f]{{32}}|{_DASHED}|\{{{_DASHED}\}}|urn:uuid:{_DASHED})$"


#: Numbers and texts that are whole numbers, "2.0" included.
WHOLE = r"^\s*[+]?0*[0-9]{1,18}(?:\.0*)?\s*$"


def _from_columns(df: DataFrame) -> dict[str, tuple]:
    """(text, is it there, is it null, is it of a kind that will do) of each field, from text columns, where null counts as absent."""
    c = {n: F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string") for n in REQUEST_FIELDS}
    return {n: (v, v.isNotNull(), F.lit(False), F.lit(True)) for n, v in c.items()}


def _from_request(df: DataFrame) -> dict[str, tuple]:
    """As _from_columns, from the values of `request`, by their kinds."""
    out = {}
    for n in REQUEST_FIELDS:
        value = F.variant_get("request", f"$.{n}", "variant")
        kind = F.schema_of_variant(value)
        number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)") | (kind == "STRING") if n == "sampling_rate" else kind == "STRING"
        text = F.try_variant_get("request", f"$.{n}", "string")
        if n == "sampling_rate":
            text = F.when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).when(kind.rlike("^(DOUBLE|FLOAT)"), F.try_variant_get("request", f"$.{n}", "double").cast("decimal(38,6)").cast("string")).otherwise(text)
        out[n] = text, value.isNotNull(), F.coalesce(kind == "VOID", F.lit(False)), F.coalesce(number, F.lit(False))
    return out


def validate_requests(df: DataFrame) -> DataFrame:
    """Adds errors (names of what is wrong, in order) and fills in defaults.

    With a column `request` (of `read_job_requests`) an absent field is told from null, and text from numbers: null is an error
    but for sns_topic_arn, as is a number where text is due; a sampling rate may be a whole number, 2.0, true or such a number as
    text. Without it all columns come as text, and null or no column counts as absent. Valid video ids come in lower case
    with hyphens. A line that is no JSON object has the one error "not json".
    """
    fields = _from_request(df) if "request" in df.columns else _from_columns(df)
    out = df.withColumns({f"{p}_{n}": x for n, f in fields.items() for p, x in zip("vhnk", f, strict=True)})
    of = lambda p, n: F.col(f"{p}_{n}")
    text = {n: F.when(of("k", n), of("v", n)) for n in fields}
    rate = F.when(text["sampling_rate"].rlike(WHOLE), F.regexp_replace(F.trim(F.regexp_replace(text["sampling_rate"], r"^\s+|\s+$", "")), r"^[+]|\.0*$", "")).cast("long")
    bad = [F.when(~of("h", n) | of("n", n), F.lit(f"{n} missing")).when(~of("k", n), F.lit(f"{n} not text")) for n in REQUIRED]
    bad.append(F.when(text["video_id"].isNotNull() & ~text["video_id"].rlike(UUID), F.lit("video_id not a uuid")))
    bad.append(F.when(of("h", "sns_topic_arn") & ~of("n", "sns_topic_arn") & ~of("k", "sns_topic_arn"), F.lit("sns_topic_arn")))
    bad.append(F.when(of("h", "sampling_rate") & ~F.coalesce(rate >= 1, F.lit(False)), F.lit("sampling_rate")))
    bad.append(F.when(of("h", "analyzer_mode") & ~F.coalesce(text["analyzer_mode"].isin("single", "multi"), F.lit(False)), F.lit("analyzer_mode")))
    bad.append(F.when(of("h", "method") & text["method"].isNull(), F.lit("method")))
    errors = F.filter(F.array(*bad), lambda x: x.isNotNull())
    if "_corrupt_record" in df.columns:
        errors = F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("not json"))).otherwise(errors)
    plain = F.regexp_replace(F.lower(text["video_id"]), "^urn:uuid:|[{}-]", "")
    dashed = F.concat_ws("-", *[F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    filled = {n: text[n] for n in (*REQUIRED[1:], "sns_topic_arn")} | {
        "sampling_rate": F.when(of("h", "sampling_rate"), rate).otherwise(F.lit(1)).cast("long"),
        "analyzer_mode": F.when(of("h", "analyzer_mode"), text["analyzer_mode"]).otherwise(F.lit("single")),
        "method": F.when(of("h", "method"), text["method"]).otherwise(F.lit("esrgan")),
        "video_id": F.when(text["video_id"].rlike(UUID), dashed).otherwise(F.lower(text["video_id"])),
        "errors": errors,
    }
    return out.withColumns(filled).drop(*[f"{p}_{n}" for n in fields for p in "vhnk"])


def job_state(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold updates (job_id, seq, status, progress, message, result_s3_uri, error, updated_at) into a state per job.

    A null field leaves the state as it is; updates of unknown jobs are ignored.
    """
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f)
    fields = [f for f in ("status", "progress", "message", "result_s3_uri", "error") if f in updates.columns]
    folded = updates.groupBy("job_id").agg(*[last(f) for f in fields], F.max_by("updated_at", "seq").alias("updated_at"))
    rows = jobs.select("job_id").join(folded, "job_id", "left")
    return rows.withColumns({"status": F.coalesce("status", F.lit("queued")), "progress": F.coalesce("progress", F.lit(0.0)), "message": F.coalesce("message", F.lit(""))})


def get_jobs(state: DataFrame, ids: DataFrame) -> DataFrame:
    """The states of the ids asked for; found tells whether there is one."""
    return ids.join(state.withColumn("found", F.lit(True)), "job_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


#: Progress at fixed points of a job (fixed values).
MILESTONES = {"downloading": 0.05, "processing": 0.10, "uploading": 0.85, "publishing": 0.95, "completed": 1.0}


def milestone_progress(updates: DataFrame) -> DataFrame:
    """Updates with the progress of their status's milestone where they state none."""
    fixed = F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in MILESTONES.items()])
    return updates.withColumn("progress", F.coalesce("progress", fixed))


def stage_progress(frames: DataFrame, stage: str = "Processing") -> DataFrame:
    """Progress reports of the frames that were not skipped: pct, progress (0.1 + 0.7 * pct) and message.

    Needs video_id, frame and skipped; pct counts all planned frames, skipped ones make no report.
    """
    w = Window.partitionBy("video_id")
    pct = F.row_number().over(w.orderBy("frame")) / F.count(F.lit(1)).over(w)
    rows = frames.withColumn("pct", pct).where("not skipped")
    return rows.withColumns({"progress": F.lit(0.1) + F.col("pct") * 0.7, "message": F.format_string("%s (%d%%)", F.lit(stage), F.bround(F.col("pct") * 100).cast("int"))})


def resolve_topic(requests: DataFrame, default: str | None) -> DataFrame:
    """Requests with a topic of their own or the default one; without either nothing is published."""
    topic = F.coalesce(F.nullif("sns_topic_arn", F.lit("")), F.nullif(F.lit(default).cast("string"), F.lit("")))
    return requests.withColumn("topic", topic).where("topic is not null")


def completion_text(jobs: DataFrame, clips: DataFrame, published: Column | None = None) -> DataFrame:
    """message of each finished job: clips found and events published (none where `published` is false)."""
    n = clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    rows = jobs.join(n, "video_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    events = F.col("n") if published is None else F.when(published, F.col("n")).otherwise(F.lit(0))
    return rows.withColumn("message", F.format_string("Completed. %d clips detected, %d events published.", "n", events)).drop("n")


def completed_jobs(requests: DataFrame, results: DataFrame) -> DataFrame:
    """status per request: completed with a result, else failed; a result without fps counts as 30."""
    rows = requests.join(results.withColumn("has", F.lit(True)), "video_id", "left")
    return rows.withColumns({"status": F.when(F.col("has"), "completed").otherwise("failed"), "fps": F.when(F.col("has"), F.coalesce("fps", F.lit(30.0)))}).drop("has")
