"""Readers, writers and the status stream."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.operators import events
from reelspark.operators import clips, frames, responses, tracking
from reelspark.sources import commits, packed, readers, sinks
from reelspark.streaming import finalised, status


def test_tracking_round_trip(spark, tmp_path):
    doc = {"video": "v", "model": "m", "fps": 30.0, "video_size": [1920, 1080], "num_objects": 1, "frames": [{"frame": 0, "athletes": [{"track_id": 1, "box": [1, 2, 3, 4], "mask_area": 9}]}, {"frame": 1, "athletes": []}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "abc.json").write_text(json.dumps(doc, indent=1))
    got = readers.read_tracking(spark, str(tmp_path / "in"))
    row = got.first()
    assert row.video_id == "abc" and row.frames[0].athletes[0].box == [1.0, 2.0, 3.0, 4.0] and row.frames[1].athletes == []
    sinks.write_tracking(got, str(tmp_path / "out"))
    text = json.loads(packed.read_packed(spark, str(tmp_path / "out")).first()["document"])
    assert text["frames"][0]["athletes"][0]["mask_area"] == 9 and text["num_objects"] == 1 and text["video"] == "v"
    assert readers.read_tracking(spark, str(tmp_path / "out"), packed=True).first().video_id == "abc"


def test_detections_round_trip(spark, tmp_path):
    doc = {"video": "v", "frame_idx": 3, "video_size": [10, 20], "persons": [{"box": [1, 2, 3, 4], "confidence": 0.5, "track_id": 1}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps(doc))
    rows = readers.explode_persons(readers.read_detections(spark, str(tmp_path / "in")))
    assert rows.first().det_idx == 0
    sinks.write_detections(rows, str(tmp_path / "out"))
    assert json.loads(packed.read_packed(spark, str(tmp_path / "out")).first()["document"])["persons"][0]["confidence"] == 0.5
    sinks.write_detections(rows.withColumns({"video": F.lit("v.mp4"), "video_size": F.array(F.lit(10), F.lit(20))}), str(tmp_path / "named"))
    again = readers.read_detections(spark, str(tmp_path / "named"), packed=True).first()
    assert (again.video, again.video_size, again.video_id, again.frame_idx) == ("v.mp4", [10, 20], "x", 3)


def test_raw_log_and_result(spark, tmp_path):
    schema = "video_id long, window_no long, is_final boolean, window string, frames array<long>, analysis struct<current_context_summary:string>, raw_error string"
    df = spark.createDataFrame([(1, 2, True, "final", [4], ("b",), None), (1, 1, False, "1", [1, 2], ("a",), None), (1, 1, False, "1", None, None, "oops")], schema)
    sinks.write_raw(df, str(tmp_path / "raw"))
    log = json.loads(packed.read_packed(spark, str(tmp_path / "raw")).first()["document"])
    assert sorted(str(x["window"]) for x in log) == ["1", "1", "final"] and log[0]["window"] == 1 and log[-1]["frames"] == [4]
    res = spark.createDataFrame([(1, "s", None)], "video_id long, match_summary string, fps double").withColumn("clips", F.array().cast("array<string>"))
    sinks.write_result(res, str(tmp_path / "res"))
    assert json.loads(packed.read_document(spark, str(tmp_path / "res"), 1)) == {"match_summary": "s", "clips": [], "fps": None}


def test_messages_and_requests(spark, tmp_path):
    df = spark.createDataFrame([(1, "{}", {"a": "b"})], "video_id long, body string, attributes map<string,string>")
    sinks.write_messages(df, str(tmp_path / "m"))
    row = spark.read.parquet(str(tmp_path / "m")).first()
    assert row.key == "1" and row.headers[0].key == "a" and bytes(row.headers[0].value) == b"b"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"video_id":"x","sampling_rate":2}\nnot json\n')
    got = readers.read_job_requests(spark, str(tmp_path / "r")).collect()
    assert {(x.video_id, x.sampling_rate) for x in got} == {("x", "2"), (None, None)}
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.json").write_text('{"video_id":1,"window_no":1,"is_final":false,"response":"{}"}')
    assert readers.read_responses(spark, str(tmp_path / "w")).first().response == "{}"


def envelope(video, index, total, at):
    done = index is None
    body = {"video_id": video, "job_id": "j", "total_event_count": total, "result_s3_uri": None} if done else {"id": f"{video}-{index}", "video_id": video, "start_time": "00:00:00", "end_time": "00:00:01", "event_candidates": []}
    attrs = {"event_type": "analysis_complete"} if done else {"event_type": "bjj_event_detected", "event_index": str(index), "total_events": str(total), "category": "X"}
    return {"Type": "Notification", "MessageId": f"{video}-{index}-{at}", "TopicArn": "t", "Message": json.dumps(body), "MessageAttributes": {k: {"Type": "String", "Value": v} for k, v in attrs.items()}, "Timestamp": f"2024-01-01T00:00:{at:02d}Z"}


def test_status_stream_equals_batch(spark, tmp_path):
    r = random.Random(11)
    feed = []
    for v, n, lost, done in (("a", 3, False, True), ("b", 2, True, True), ("c", 2, False, False), ("d", 0, False, True)):
        rows = [envelope(v, i, n, i) for i in range(1, n + 1) if not (lost and i == 1)]
        feed += rows + rows[:1] + ([envelope(v, None, n, 50)] if done else [])
    r.shuffle(feed)
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, feed[k::3])))
        stream = events.parse_envelope(readers.read_messages(spark, str(tmp_path / "in"), streaming=True))
        status.run_status_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))  # stopped and started again each time
    got = {x.video_id: (x.received_count, x.completion_received, x.finalized) for x in status.read_status(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": (3, True, True), "b": (1, True, False), "c": (2, False, False), "d": (0, True, True)}
    batch = events.video_status(events.parse_envelope(readers.read_messages(spark, str(tmp_path / "in"))))
    assert {x.video_id: x.received_count for x in batch.collect()} == {v: g[0] for v, g in got.items()}
    assert {x.video_id for x in events.finalise(batch).collect()} == {"a", "d"}
    assert {x.video_id: x.job_id for x in batch.collect()} == {"a": "j", "b": "j", "c": None, "d": "j"}
    # the same batch once more changes nothing
    status.upsert_status(events.parse_envelope(readers.read_messages(spark, str(tmp_path / "in"))), 0, str(tmp_path / "out"))
    assert status.read_status(spark, str(tmp_path / "out")).where("finalized").count() == 2


def test_stream_dedupe(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(envelope("a", 1, 1, 1)) for _ in range(3)))
    stream = events.parse_envelope(readers.read_messages(spark, str(tmp_path / "in"), streaming=True))
    once = events.dedupe_messages(stream, ("video_id", "event_index"))
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1


def feed_rows(spark, rows):
    """Parsed messages from (video, index or None for completion, total, second)."""
    values = [(json.dumps(envelope(*r)),) for r in rows]
    from reelspark.schemas import ENVELOPE

    return events.parse_envelope(spark.createDataFrame(values, "value string").select(F.from_json("value", ENVELOPE).alias("e")).select("e.*"))


def as_status(rows):
    got = {}
    for v, i, n, _ in rows:
        seen, done, total = got.get(v, (set(), False, 0))
        got[v] = (seen | ({i} if i is not None else set()), done or i is None, n)
    return {v: (len(s), d, d and len(s) >= n) for v, (s, d, n) in got.items()}


def table_of(spark, path):
    t = status.read_status(spark, path)
    return {} if t is None else {x.video_id: (x.received_count, x.completion_received, x.finalized) for x in t.collect()}


def test_status_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    """Whatever call a batch breaks off at, before it or after it, the table is as it was or as it is to be."""
    path = str(tmp_path / "t")
    first = [(f"v{i}", 1, 2, 1) for i in range(5)]
    second = [("v1", 2, 2, 2), ("v1", None, 2, 3), ("new", None, 0, 4)]
    status.upsert_status(feed_rows(spark, first), 0, path)
    before, after = as_status(first), as_status(first + second)

    class Stop(Exception):
        pass

    for name in ("_staged", "_merged", "newest", "commit", "_rename", "remove", "clean"):
        for late in (False, True):
            with monkeypatch.context() as m:
                owner = status if hasattr(status, name) else commits.Versions
                whole = getattr(owner, name)

                def broken(*a, whole=whole, late=late):
                    if late:
                        whole(*a)
                    raise Stop

                m.setattr(owner, name, broken)
                with pytest.raises(Stop):
                    status.upsert_status(feed_rows(spark, second), 1, path)
            assert table_of(spark, path) in (before, after)
    status.upsert_status(feed_rows(spark, second), 1, path)
    assert table_of(spark, path) == after
    # a version that was cut off while it was written is passed over
    (tmp_path / "t" / "versions" / f"{10**6:020d}.json").write_text("12ab\n{")
    assert table_of(spark, path) == after
    status.upsert_status(feed_rows(spark, [("v2", None, 2, 9)]), 2, path)
    assert table_of(spark, path) == as_status([*first, *second, ("v2", None, 2, 9)])


def test_status_parts_split_and_few_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(status, "PART_ROWS", 8)
    path = str(tmp_path / "t")
    rows = [(f"v{i}", k, 2, k) for i in range(60) for k in (1, 2)]
    for k in range(3):
        status.upsert_status(feed_rows(spark, rows[k::3]), k, path)
    v = commits.Versions(spark, path)
    parts = v.newest()["parts"]
    assert sum(p["rows"] for p in parts.values()) == 120 and max(p["rows"] for p in parts.values()) <= 16 and len(parts) >= 10
    assert sum(2.0 ** -int(n.split("-")[0]) for n in parts) == 1.0  # they share all hashes out among them
    status.upsert_status(feed_rows(spark, [("v7", None, 2, 9)]), 3, path)
    assert len([n for n, p in v.newest()["parts"].items() if parts.get(n) != p]) <= 2
    assert table_of(spark, path) == as_status([*rows, ("v7", None, 2, 9)])
    # files of old versions have gone
    status.upsert_status(feed_rows(spark, [("v7", 1, 2, 10)]), 4, path)
    named = {x for p in parts.values() for x in p.values() if isinstance(x, str)}
    now = {x for n in v._numbers() for p in v._read(n)["parts"].values() for x in p.values() if isinstance(x, str)}
    assert len(v._numbers()) == commits.KEPT and not any((tmp_path / "t" / x).exists() for x in named - now) and all((tmp_path / "t" / x).exists() for x in now)


def test_status_of_two_writers(spark, tmp_path, monkeypatch):
    """A writer that another overtook merges its batch again."""
    path, whole, done = str(tmp_path / "t"), status._merged, []

    def overtaken(staged, v, base):
        out = whole(staged, v, base)
        if not done:
            done.append(1)
            status.upsert_status(feed_rows(spark, [("a", 1, 2, 1)]), 0, path)
        return out

    monkeypatch.setattr(status, "_merged", overtaken)
    status.upsert_status(feed_rows(spark, [("a", 2, 2, 2), ("b", None, 0, 1)]), 0, path)
    assert table_of(spark, path) == {"a": (2, False, False), "b": (0, True, True)}


# ---- documents of any number and length

def test_packed_documents(spark, tmp_path):
    """Files follow the bytes, not the videos, and each document is found by its bytes alone."""
    path = str(tmp_path / "p")
    texts = {f'v"{i}\\é': json.dumps({"n": i, "t": "é\n\u2028" * (i % 5)}, ensure_ascii=i % 2 == 0) for i in range(300)}
    rows = spark.createDataFrame([*texts.items(), ("none", None)], "video_id string, value string")
    packed.write_packed(rows, path, file_bytes=6000)
    size = sum(len(t.encode()) for t in texts.values())
    files = [f for f in (tmp_path / "p").rglob("part-*") if "lines" in str(f)]
    assert size / 6000 / 2 < len(files) <= 2 + 3 * size / 6000 and len(files) < 30
    got = {x.video_id: x.document for x in packed.read_packed(spark, path).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {k: json.loads(v) for k, v in texts.items()}
    for v in list(texts)[::29]:
        assert packed.read_document(spark, path, v) == texts[v]
    assert packed.read_document(spark, path, "none") is None
    # written again, it is another table; its readers see the old one or the new one
    packed.write_packed(rows.limit(1), path)
    assert packed.read_packed(spark, path).count() == 1
    packed.write_packed(rows.limit(0), path)
    assert packed.read_packed(spark, path).count() == 0 and packed.read_manifest(spark, path).count() == 0


def test_a_sink_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([("a", "{}"), ("b", "[1]")], "video_id string, value string")
    packed.write_packed(rows, path)
    monkeypatch.setattr(commits.Versions, "_rename", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        packed.write_packed(rows.where("video_id = 'a'"), path)
    assert {x.video_id for x in packed.read_packed(spark, path).collect()} == {"a", "b"}


def tracking_tables(spark, n):
    frame_map = [("v", i, i * 2 if i % 3 else None) for i in range(n)] + [("w", 5, None)]
    tracks = [("v", i, t, [1.0 * i, 2.0, 3.0, 4.0 + t], i + t) for i in range(2, n) for t in range(1, 1 + i % 3)]
    videos = spark.createDataFrame([("v", 1920, 1080, 30.0), ("w", 10, 20, None), ("x", 1, 1, 1.0)], "video_id string, width int, height int, fps double")
    return spark.createDataFrame(tracks, "video_id string, local_idx long, track_id int, box array<double>, mask_area long"), spark.createDataFrame(frame_map, "video_id string, local_idx long, frame long"), videos


@pytest.mark.parametrize("per", [1000, 7])
def test_fragments_are_the_document(spark, tmp_path, per):
    tracks, frame_map, videos = tracking_tables(spark, 40)
    whole = tracking.tracking_document(tracks, frame_map, videos)
    sinks.write_tracking(whole, str(tmp_path / "whole"))
    parts = tracking.tracking_fragments(tracks, frame_map, videos, per=per)
    sinks.write_tracking(parts, str(tmp_path / "parts"))
    for v in ("v", "w"):
        a, b = (packed.read_document(spark, str(tmp_path / d), v) for d in ("whole", "parts"))
        assert json.loads(a) == json.loads(b) and a == b
    assert parts.where("video_id = 'v'").count() == (1 if per == 1000 else 7)
    as_rows = lambda d: sorted((x.video_id, x.frame, [(a.track_id, a.box) for a in x.athletes]) for x in d.collect())
    read = [readers.read_tracking_frames(spark, str(tmp_path / d), packed=True) for d in ("whole", "parts")]
    assert as_rows(read[0]) == as_rows(read[1])
    order = [x.frame for x in read[1].where("video_id = 'v'").orderBy("pos").collect()]
    assert order == [i * 2 if i % 3 else i for i in range(40)]


def test_fragments_are_compared_and_parsed_once(spark, tmp_path):
    """Lists are sorted natively, and a line is parsed at once with its document, whatever its id holds."""
    tracks, frame_map, videos = tracking_tables(spark, 20)
    name = F.concat("video_id", F.lit('\\",\"document\":[ "document":'))
    tracks, frame_map, videos = (x.withColumn("video_id", name) for x in (tracks, frame_map, videos))
    parts = tracking.tracking_fragments(tracks, frame_map, videos, per=7)
    assert "array_sort" not in parts._jdf.queryExecution().optimizedPlan().toString()
    sinks.write_tracking(parts, str(tmp_path / "p"))
    read = readers.read_tracking_frames(spark, str(tmp_path / "p"), packed=True)
    # a line is of one of two kinds, and each kind has one parser
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2 and "text" in read._jdf.queryExecution().executedPlan().toString()
    got = sorted((x.video_id[0], x.video_id[1:], x.frame, len(x.athletes)) for x in read.collect())
    assert got == sorted([("v", '\\","document":[ "document":', i * 2 if i % 3 else i, i % 3 if i >= 2 else 0) for i in range(20)] + [("w", '\\","document":[ "document":', 5, 0)])


def test_long_documents_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """As json.dump writes them, with or without indentation; one file by several tasks, with the rows that a whole reading gives."""
    docs = {}
    for name, indent, n in (("plain", None, 400), ("wide", 2, 400), ("one", 2, 1), ("none", 2, 0)):
        items = [{"frame": i % 350, "timestamp": i / 30, "athletes": [{"track_id": t, "box": [i, 1.5, 2, 3], "mask_area": i} for t in range(i % 3)]} for i in range(n)]
        docs[name] = {"video": 'a "frame": b', "model": "m", "fps": 30, "video_size": [4, 5], "num_objects": 2, "frames": items}
        (tmp_path / f"{name}.json").write_text(json.dumps(docs[name], indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        pieces = readers.read_tracking_frames(spark, str(tmp_path))
        assert pieces.where("video_id = 'wide'").select(F.spark_partition_id()).distinct().count() > 3
        got = sorted((x.video_id, x.frame, x.timestamp, len(x.athletes)) for x in pieces.collect())
        assert got == sorted((v, f["frame"], f["timestamp"], len(f["athletes"])) for v, d in docs.items() for f in d["frames"])
        for v in ("plain", "wide"):
            assert [x.timestamp for x in pieces.where(F.col("video_id") == v).orderBy("pos").collect()] == [f["timestamp"] for f in docs[v]["frames"]]
        key = lambda d: sorted((x.video_id, x.frame, len(x.athletes), [a.mask_area for a in x.athletes]) for x in d.collect())
        assert key(frames.last_frames(pieces)) == key(frames.explode_frames(readers.read_tracking(spark, str(tmp_path))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.json").write_text('{"frames": [{"athletes": [], "frame": 1}]}')
    with pytest.raises(Exception, match="begins with its number"):
        readers.read_tracking_frames(spark, str(tmp_path / "odd")).collect()


def test_last_frame_needs_no_exchange(spark):
    df = spark.createDataFrame([("v", [(3, [1]), (1, [2]), (3, [4]), (None, [5]), (None, [6])]), ("w", []), ("x", None)], "video_id string, frames array<struct<frame: long, athletes: array<int>>>")
    out = frames.explode_frames(df)
    assert [(x.video_id, x.frame, x.athletes) for x in out.collect()] == [("v", None, [6]), ("v", 1, [2]), ("v", 3, [4])]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# ---- answers and requests with values of any kind

def test_answers_pass_through_whole(spark, tmp_path):
    """Keys that nobody asked for, nulls and values of other types come out of the log and the result as they came in."""
    clips_in = [{"start_frame": 5, "end_frame": 50, "category": "A", "confidence": 0.5, "role": None, "score_delta": {"a": [1, None, "x"]}}, {"start_frame": 60, "end_frame": 70, "category": "A", "confidence": 0.9, "reasoning": 7, "mood": True}, {"start_frame": 500, "end_frame": 510, "category": "B"}]
    answers = [{"current_context_summary": 3, "clips": clips_in, "extra": [{"k": None}]}, {"error": None, "note": "a\nb"}, {"clips": [{"start_frame": "5", "end_frame": [1], "category": None}]}]
    rows = [("v", i + 1, i == 2, json.dumps(a, indent=1)) for i, a in enumerate(answers)] + [("v", 4, False, "no")]
    parsed = responses.parse_responses(spark.createDataFrame(rows, "video_id string, window_no long, is_final boolean, response string"))
    sinks.write_raw(responses.raw_records(parsed), str(tmp_path / "raw"))
    log = json.loads(packed.read_document(spark, str(tmp_path / "raw"), "v"))
    assert [x.get("analysis") for x in log] == [answers[0], answers[1], None, answers[2]] and [x["window"] for x in log] == [1, 2, 4, "final"] and log[2]["raw_error"] == "no"
    one = clips.explode_clips(parsed)
    good, bad = clips.quarantine_clips(one)
    assert bad.count() == 1
    merged = clips.merge_clips(good)
    sinks.write_result(clips.result_document(merged, spark.createDataFrame([("v", 30.0), ("w", None)], "video_id string, fps double")), str(tmp_path / "res"))
    got = json.loads(packed.read_document(spark, str(tmp_path / "res"), "v"))
    assert got["clips"] == [clips_in[1] | {"start_frame": 5, "end_frame": 70}, clips_in[2]]
    assert json.loads(packed.read_document(spark, str(tmp_path / "res"), "w"))["clips"] == []
    # without the answer's text, clips have the typed fields
    assert clips.explode_clips(parsed.drop("body")).count() == 4


def test_request_fields_have_kinds(spark, tmp_path):
    from reelspark.operators import jobs
    from reelspark.schemas import REQUIRED

    good = {c: "x" for c in REQUIRED} | {"video_id": "00000000-0000-0000-0000-00000000000A"}
    cases = [({}, []), ({"sampling_rate": None}, ["sampling_rate"]), ({"sampling_rate": 2.0}, []), ({"sampling_rate": 2.5}, ["sampling_rate"]), ({"sampling_rate": " +2 "}, []), ({"sampling_rate": True}, []), ({"sampling_rate": False}, ["sampling_rate"]), ({"sampling_rate": [1]}, ["sampling_rate"]), ({"sampling_rate": 1e3}, []), ({"sampling_rate": 2.00000000001}, ["sampling_rate"])]
    cases += [({"analyzer_mode": None}, ["analyzer_mode"]), ({"analyzer_mode": 1}, ["analyzer_mode"]), ({"analyzer_mode": "multi"}, []), ({"method": None}, ["method"]), ({"method": 3}, ["method"]), ({"method": ""}, []), ({"sns_topic_arn": None}, []), ({"sns_topic_arn": 4}, ["sns_topic_arn"])]
    cases += [({"output_s3_key": 5}, ["output_s3_key not text"]), ({"output_s3_key": None}, ["output_s3_key missing"]), ({"video_id": 7}, ["video_id not text"]), ({"video_id": {"a": 1}}, ["video_id not text"]), ({"more": {"x": None}}, [])]
    lines = [json.dumps(good | c) for c, _ in cases] + ["[1]", "nope", '{"video_id": "a"', ""]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text("\n".join(lines))
    got = jobs.validate_requests(readers.read_job_requests(spark, str(tmp_path / "r")).coalesce(1)).collect()
    assert [x.errors for x in got] == [e for _, e in cases] + [["not json"]] * 3
    assert [got[i].sampling_rate for i in (0, 2, 4, 5, 8)] == [1, 2, 2, 1, 1000] and got[0].video_id.endswith("a") and got[0].method == "esrgan"


# ---- videos as they become complete

def test_finalised_once(spark, tmp_path):
    """Whatever the order, repetitions and restarts: each complete video once, as the batch has them."""
    r, feed = random.Random(2), []
    for i in range(25):
        n, lost, done = r.choice([0, 1, 3, 9000 if i == 3 else 4]), r.random() < 0.2, r.random() < 0.8
        rows = [envelope(f"v{i}", k, n, k % 50) for k in ([1, 8191, 8192, 8193] if n == 9000 else range(1, n + 1)) if not (lost and k == 1)]
        feed += rows + r.sample(rows, len(rows) // 2) + ([envelope(f"v{i}", None, 4 if n == 9000 else n, 50)] * 2 if done else [])
    r.shuffle(feed)
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, feed[k::3] + feed[:10] * k)))
        finalised.run_finalised_stream(events.parse_envelope(readers.read_messages(spark, str(tmp_path / "in"), streaming=True)), out, check)
    got = [tuple(x) for x in spark.read.parquet(out).select("video_id", "received_count", "expected_total", "job_id").collect()]
    batch = events.finalise(events.video_status(events.parse_envelope(readers.read_messages(spark, str(tmp_path / "in")))))
    assert sorted(got) == sorted(tuple(x) for x in batch.select("video_id", "received_count", "expected_total", "job_id").collect()) and len(got) > 5
    pages = spark.read.format("statestore").option("stateVarName", "pages").option("path", check).load()
    assert not {x.key.video_id for x in pages.select("key").collect()} & {v for v, *_ in got}


def test_marks_of_finished_videos_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(envelope(f"v{k}", None, 0, 1)))
        finalised.run_finalised_stream(events.parse_envelope(readers.read_messages(spark, str(tmp_path / "in"), streaming=True)), out, check, keep_ms=1)
    assert spark.read.parquet(out).count() == 3
    left = spark.read.format("statestore").option("stateVarName", "seen").option("path", check).load()
    assert {x.key.video_id for x in left.select("key").collect()} <= {"v1", "v2"}


def test_messages_reach_the_state_summed_up(spark):
    """One row for each video of a task, as the batch counts; messages without a video, kind, index or total."""
    e, c = events.EVENT, events.COMPLETE
    rows = [("v", e, i % 40, 40, "x", "y") for i in range(200)] + [("v", e, None, 41, None, None), ("v", None, 77, None, None, None), ("v", c, 90, 39, None, "a"), ("v", c, None, None, "j", "b"), ("v", c, None, 38, "i", None)]
    rows += [(None, e, 1, 1, None, None), ("w", c, None, 0, "é", None), ("x", e, 1 << 40, None, None, None)]
    names = ["video_id", "event_type", "event_index", "total_events", "job_id", "result_s3_uri"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    got = [r for b in finalised.summaries(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert [{**r, "indices": sorted(np.frombuffer(r["indices"], "<i8").tolist())} for r in got] == [
        {"video_id": "v", "indices": list(range(40)), "total": 41, "told": 39, "completion": True, "job_id": "j", "result_s3_uri": "b"},
        {"video_id": "w", "indices": [], "total": 0, "told": 0, "completion": True, "job_id": "é", "result_s3_uri": None},
        {"video_id": "x", "indices": [1 << 40], "total": None, "told": None, "completion": False, "job_id": None, "result_s3_uri": None},
    ]
    assert list(finalised.summaries(iter([]))) == list(finalised.summaries(iter(table.slice(205, 1).to_batches()))) == []
