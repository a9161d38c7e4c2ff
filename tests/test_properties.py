"""Operators against small folds written from scratch, and their borders."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.functions.columns import frame_to_timestamp, hist_correlation, l2_normalize
from reelspark.schemas import REQUIRED
from reelspark.operators import clips, detections, events, frames, geometry, jobs, reid, responses, scan, windows


def fold(rows, gap):
    out = []
    for c in sorted(rows, key=lambda r: (r[2], r[1])):
        c = list(c)
        if out and out[-1][4] == c[4] and (min(out[-1][3], c[3]) - max(out[-1][2], c[2]) > 0 or c[2] - out[-1][3] < gap):
            a = out[-1]
            best = c if (c[5] or 0) > (a[5] or 0) else a
            out[-1] = [a[0], a[1], min(a[2], c[2]), max(a[3], c[3]), a[4], best[5]]
        else:
            out.append(c)
    return [tuple(x[2:]) for x in out]


def test_merge_clips_is_the_left_fold(spark):
    r = random.Random(7)
    rows = []
    for v in range(120):
        for p in range(r.randint(0, 12)):
            start = r.randint(0, 150)
            rows.append((v, p, start, start + r.randint(-5, 60), r.choice(["A", "B", None]), r.choice([None, 0.0, 0.5, 0.5, 0.9])))
    df = spark.createDataFrame(rows, "video_id long, pos long, start_frame long, end_frame long, category string, confidence double")
    got = {}
    for x in clips.merge_clips(df, 30).orderBy("video_id", "clip_no").collect():
        got.setdefault(x.video_id, []).append((x.start_frame, x.end_frame, x.category, x.confidence))
    for v in range(120):
        assert got.get(v, []) == fold([x for x in rows if x[0] == v], 30)


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_merge_by_ranges_is_the_left_fold(spark, pieces):
    """One video with most of all clips, whose runs and islands go on over cuts, and many small ones."""
    r = random.Random(13)
    rows = [(0, p, r.randint(0, 4000), 0, r.choice(["A", "A", "A", "B", None]), r.choice([None, 0.0, 0.5, 0.9])) for p in range(300)]
    rows += [(1, p, p, 5000 if p == 0 else p + 3, "A", 0.1) for p in range(80)]  # one island over many pieces
    rows += [(v, p, r.randint(0, 150), 0, r.choice(["A", "B"]), 0.5) for v in range(2, 30) for p in range(r.randint(1, 4))]
    rows = [(v, p, s, e or s + r.randint(-5, 40), c, k) for v, p, s, e, c, k in rows]
    df = spark.createDataFrame(rows, "video_id long, pos long, start_frame long, end_frame long, category string, confidence double")
    got = {}
    for x in clips.merge_clips(df, 30, pieces=pieces).orderBy("video_id", "clip_no").collect():
        got.setdefault(x.video_id, []).append((x.start_frame, x.end_frame, x.category, x.confidence))
        assert x.clip_no == len(got[x.video_id])
    for v in range(30):
        assert got.get(v, []) == fold([x for x in rows if x[0] == v], 30)


def test_giant_videos_are_cut(spark):
    """Numbers, limits, windows and events by ranges are those by video, and no range has a giant video whole."""
    rows = [(0, f * 3) for f in range(400)] + [(v, f) for v in range(1, 40) for f in range(v % 4)]
    df = spark.createDataFrame(rows, "video_id long, frame long")
    as_set = lambda d: sorted(map(str, d.collect()))
    assert as_set(frames.limit_frames(df, 250, pieces=8)) == as_set(frames.limit_frames(df, 250))
    assert as_set(windows.sliding_windows(df, 7, 3, pieces=8)) == as_set(windows.sliding_windows(df, 7, 3))
    assert scan.dealt(df, ("frame",), 8).where("video_id = 0").groupBy("piece").count().agg(F.max("count")).first()[0] < 150
    many = df.select("video_id", F.col("frame").alias("clip_no"), F.col("frame").alias("start_frame"), (F.col("frame") + 1).alias("end_frame"), F.lit(30.0).alias("fps"), *[F.lit("x").alias(c) for c in ("role", "specific_technique", "category")], F.lit(0.5).alias("confidence"))
    assert as_set(events.clip_to_event(many, pieces=8)) == as_set(events.clip_to_event(many))
    assert clips.merge_clips(spark.createDataFrame([], "video_id long, pos long, start_frame long, end_frame long, category string, confidence double"), pieces=4).count() == 0


def test_merge_needs_one_exchange(spark):
    df = spark.createDataFrame([(1, 1, 0, 5, "A", 0.5)], "video_id long, pos long, start_frame long, end_frame long, category string, confidence double")
    plan = clips.merge_clips(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("gap,n", [(29, 1), (30, 2)])
def test_gap_is_strict(spark, gap, n):
    df = spark.createDataFrame([(1, 1, 0, 10, "A", 0.1), (1, 2, 10 + gap, 60, "A", 0.1)], "video_id long, pos long, start_frame long, end_frame long, category string, confidence double")
    assert clips.merge_clips(df, 30).count() == n


def test_quarantine_fails_fast(spark):
    df = spark.createDataFrame([(1, None, 5, 0.5)], "video_id long, start_frame long, end_frame long, confidence double")
    good, bad = clips.quarantine_clips(df)
    assert (good.count(), bad.count()) == (0, 1)
    with pytest.raises(Exception, match="bad clip"):
        clips.quarantine_clips(df, "FAILFAST")[0].collect()


def buffer_windows(n, size, stride):
    out, buf, at = [], [], 0
    for f in range(n):
        buf.append(f)
        if len(buf) == size:
            out.append((list(buf), False))
            buf = buf[min(stride, size) :]
    if buf:
        out.append((buf, True))
    return out


@pytest.mark.parametrize("size,stride", [(30, 15), (30, 40), (7, 3), (1, 1)])
def test_windows_are_the_buffer(spark, size, stride):
    lengths = [0, 1, 2, 6, 7, 8, 29, 30, 31, 44, 45, 46, 75]
    rows = [(i, f) for i, n in enumerate(lengths) for f in range(n)]
    got = windows.sliding_windows(spark.createDataFrame(rows, "video_id long, frame long"), size, stride).orderBy("video_id", "window_no").collect()
    for i, n in enumerate(lengths):
        assert [(x.frames, x.is_final) for x in got if x.video_id == i] == buffer_windows(n, size, stride)


def test_greedy_assign_is_the_loop(spark):
    r = random.Random(3)
    rows = [(0, f, c, g, r.choice([0.3, 0.4, 0.5, 0.6, 0.9])) for f in range(60) for c in range(r.randint(1, 4)) for g in range(r.randint(0, 4))]
    cands = sorted({(0, f, c) for f in range(60) for c in range(4)})
    schema = "video_id int, frame int, cand_idx int, track_id int, score double"
    out = reid.greedy_assign(spark.createDataFrame(rows, schema), spark.createDataFrame(cands, "video_id int, frame int, cand_idx int"))
    got = {(x.frame, x.cand_idx): (x.track_id, x.score) for x in out.collect()}
    for f in range(60):
        want, used = {}, set()
        for _, _, c, g, s in sorted((x for x in rows if x[1] == f), key=lambda x: (-x[4], x[3], x[2])):
            if s > 0.4 and c not in want and g not in used:
                want[c] = (g, s)
                used.add(g)
        for c in range(4):
            assert got[f, c] == want.get(c, (-1, 0.0))


def test_tiles_partition_the_image(spark):
    images = spark.createDataFrame([(1, 400, 400), (2, 401, 400), (3, 1000, 37), (4, 1200, 801)], "image_id long, width int, height int")
    for i in images.collect():
        cells = [0] * (i.width * i.height)
        for t in geometry.tile_plan(images.where(F.col("image_id") == i.image_id)).collect():
            assert t.pad_x1 <= t.x1 < t.x2 <= t.pad_x2 <= i.width
            for y in range(t.y1, t.y2):
                for x in range(t.x1, t.x2):
                    cells[y * i.width + x] += 1
        assert set(cells) == {1}


def test_crops_stay_inside(spark):
    r = random.Random(5)
    rows = [(1, i, *(r.uniform(-50, 2000) for _ in range(4)), 1920, 1080) for i in range(500)]
    df = spark.createDataFrame(rows, "video_id long, frame long, x1 double, y1 double, x2 double, y2 double, width int, height int")
    for x in geometry.square_crop(df).collect():
        assert 0 <= x.crop_x1 <= 1920 and 0 <= x.crop_x2 <= 1920 and 0 <= x.crop_y1 <= 1080 and 0 <= x.crop_y2 <= 1080


def test_times(spark):
    got = spark.createDataFrame([(0, 30.0), (3600 * 120, 1.0), (59, 1.0), (5, 0.0), (7, -1.0)], "f long, fps double").select(frame_to_timestamp("f", "fps").alias("t")).collect()
    assert [x.t for x in got] == ["00:00:00", "120:00:00", "00:00:59", "00:00:00", "00:00:00"]


def test_limits(spark):
    df = spark.createDataFrame([(1, f) for f in range(5)], "video_id long, frame long")
    assert frames.limit_frames(df, 0).count() == 5 == frames.limit_frames(df, None).count()
    assert frames.limit_frames(df, 2).count() == 2
    with pytest.raises(ValueError):
        frames.limit_frames(df, -1)
    with pytest.raises(ValueError):
        frames.sample_frames(df, 0)


def test_json_is_strict(spark):
    texts = ['{"clips":[]}', '{"clips":[]} junk', "[1]", "3", "null", "", "{'clips':[]}", '{"a":1},{"b":2}', '```json\n{"error":"x"}\n```', 'a ``` {"clips":null} ``` b']
    rows = [(1, i, False, t) for i, t in enumerate(texts)] + [(1, 99, True, "bad")]
    got = responses.parse_responses(spark.createDataFrame(rows, "video_id long, window_no long, is_final boolean, response string")).orderBy("window_no").collect()
    assert [x.parse_ok for x in got] == [True, False, False, False, False, False, False, False, True, True]


def test_context_keeps_a_present_null(spark):
    rows = [(1, 1, False, '{"current_context_summary":"a"}'), (1, 2, False, "bad"), (1, 3, False, '{"current_context_summary":null}'), (1, 4, True, "{}")]
    got = responses.carry_context(responses.parse_responses(spark.createDataFrame(rows, "video_id long, window_no long, is_final boolean, response string"))).orderBy("window_no").collect()
    assert [x.context for x in got] == ["Start of match.", "a", "a", None]


def test_policies(spark):
    df = spark.createDataFrame([({"a": "1"},), ({"a": "2", "b": "x"},), ({},)], "attributes map<string,string>")
    assert events.filter_policy(df, {}).count() == 3
    assert events.filter_policy(df, {"a": ["1", "2"], "b": [{"exists": False}]}).count() == 1
    assert events.filter_policy(df, {"a": [{"exists": True}]}).count() == 2


def test_requests(spark):
    good = "00000000-0000-0000-0000-00000000000A"
    rows = [(good, "1", None, None), (good, "0", "both", "x"), ("bad", "1.5", "multi", None), (None, None, None, None)]
    places = [F.lit("x").alias(c) for c in REQUIRED[1:]]
    df = spark.createDataFrame(rows, "video_id string, sampling_rate string, analyzer_mode string, method string")
    got = jobs.validate_requests(df.select("*", *places)).collect()
    assert [x.errors for x in got] == [[], ["sampling_rate", "analyzer_mode"], ["video_id not a uuid", "sampling_rate"], ["video_id missing"]]
    assert (got[0].video_id, got[0].method, got[3].sampling_rate) == (good.lower(), "esrgan", 1)
    # absent columns are missing in every row
    assert jobs.validate_requests(df.limit(1)).first().errors == [f"{c} missing" for c in REQUIRED[1:]]
    forms = [good.replace("-", ""), "{" + good + "}", "urn:uuid:" + good, good[:-1], "x" + good]
    got = jobs.validate_requests(spark.createDataFrame([(x,) for x in forms], "video_id string").select("*", *places)).collect()
    assert [x.errors for x in got] == [[]] * 3 + [["video_id not a uuid"]] * 2 and {x.video_id for x in got[:3]} == {good.lower()}


def test_picks_need_two(spark):
    dets = spark.createDataFrame([(1, 0, i, [0.0] * 4) for i in range(3)] + [(2, 0, 0, [0.0] * 4)], "video_id long, frame_idx int, det_idx int, box array<double>")
    picks = spark.createDataFrame([(1, 0, 9), (1, 1, 2), (1, 2, 2), (1, 3, 0), (2, 0, 0), (2, 1, 0)], "video_id long, pick_no int, det_idx int")
    got = detections.apply_picks(dets, picks).orderBy("track_id").collect()
    assert [(x.video_id, x.det_idx, x.track_id) for x in got] == [(1, 2, 1), (1, 0, 2)]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0])], "a array<double>, b array<double>").select(l2_normalize("a").alias("n"), hist_correlation("a", "b").alias("c")).first()
    assert row.n == pytest.approx([0.6, 0.8]) and row.c == 1.0


def test_runs_are_the_pixels(spark):
    r, rows = random.Random(9), []
    for t in range(30):
        width = 13
        cells = {(r.randrange(width), r.randrange(9)) for _ in range(r.choice([1, 5, 40, 200]))}
        rows += [(1, 2, t, x, y) for x, y in cells for _ in range(1)]
    pixels = spark.createDataFrame(rows, "video_id long, frame long, track_id int, x int, y int")
    runs = geometry.mask_runs(pixels, 13)
    assert runs.select(F.sum(F.size("starts"))).first()[0] < len(rows)
    want = sorted(map(tuple, geometry.mask_bbox(pixels).select("track_id", "x1", "y1", "x2", "y2", "mask_area").collect()))
    boxes = geometry.mask_bbox_runs(runs)
    assert sorted(map(tuple, boxes.select("track_id", "x1", "y1", "x2", "y2", "mask_area").collect())) == want
    odd = spark.createDataFrame([(1, 1, 1, 10, [25, 7], [12, 0]), (1, 1, 2, 10, [], []), (1, 1, 3, 10, None, None), (1, 1, 4, 10, [3], [0])], "video_id long, frame long, track_id int, width int, starts array<long>, lengths array<long>")
    assert [tuple(x)[2:] for x in geometry.mask_bbox_runs(odd).collect()] == [(1, 0, 2, 9, 3, 12)]


def test_runs_from_sets_of_pixels(spark):
    """Pixels are held once, in sets that are sorted with spilling: no rows of pixels or runs after the only shuffle."""
    r, want, rows = random.Random(11), {}, []
    for t in range(40):
        cells = sorted({(r.randrange(7), r.randrange(6)) for _ in range(r.choice([1, 6, 30, 90]))}, key=lambda c: (c[1], c[0]))
        rows += [(1, 2, t, x, y) for x, y in cells + cells[:3]] + [(1, 2, t, 7, 0), (1, 2, t, -1, 1)]
        at = [y * 7 + x for x, y in cells]
        starts = [p for p in at if p - 1 not in at]
        want[t] = (starts, [next(n for n in range(1, 50) if s + n not in at) for s in starts])
    runs = geometry.mask_runs(spark.createDataFrame(rows, "video_id long, frame long, track_id int, x int, y int").repartition(5), 7)
    assert {x.track_id: (x.starts, x.lengths) for x in runs.collect()} == want
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Generate" not in plan


def test_score_blocks(spark, monkeypatch):
    """A video with many entries and candidates is dealt in blocks, without loss and without a hint to broadcast."""
    monkeypatch.setattr(reid.in_blocks, "__defaults__", (8, 16))
    cands = spark.createDataFrame([(v, f, c, [float(f), 1.0], None) for v, n in ((1, 40), (2, 1)) for f in range(n) for c in range(2)], "video_id long, frame long, cand_idx int, features array<double>, histogram array<double>")
    gallery = spark.createDataFrame([(v, t, [1.0, float(t)], None) for v, n in ((1, 60), (2, 1), (3, 5)) for t in range(n)], "video_id long, track_id int, features array<double>, histogram array<double>")
    got = {(x.video_id, x.frame, x.cand_idx, x.track_id): x.score for x in reid.score_matrix(cands, gallery).collect()}
    assert got == {(v, f, c, t): (f + t + 1) / 2 for v, n, m in ((1, 40, 60), (2, 1, 1)) for f in range(n) for c in range(2) for t in range(m)}
    assert "strategy=broadcast" not in reid.score_matrix(cands, gallery)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in frames.readable_prefix(spark.range(1).selectExpr("id as video_id", "id as frame"), spark.range(1).selectExpr("id as video_id", "explode(sequence(1, 5000)) as total_frames"))._jdf.queryExecution().analyzed().toString()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "video_id long, frame long")
    assert windows.sliding_windows(none).count() == 0 and frames.evenly_spaced(none).count() == 0
    none = spark.createDataFrame([], "video_id long, pos long, start_frame long, end_frame long, category string, confidence double")
    assert clips.merge_clips(none).count() == 0
