"""One query for each operator over the adapter views, each with the same statement in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.columns import cosine01, hist_correlation, l2_normalize, result_uri
from reelspark.operators import clips, detections, events, frames, geometry, jobs, reid, responses, tracking, windows
from reelspark.plans.views import view, with_views
from reelspark.sources import packed, readers, sinks
from reelspark.sources.tables import scratch
from reelspark.streaming import finalised, status

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **parts: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql, **parts)
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- clips and events

RANKED = "select *, row_number() over (partition by video_id order by start_frame, pos) as rk, lag(category) over (partition by video_id order by start_frame, pos) as lc from v_clips"
RUNS = "select *, sum(case when rk = 1 or category is distinct from lc then 1 else 0 end) over (partition by video_id order by rk) as run from ranked"
PREV = "select *, max(end_frame) over (partition by video_id, run order by rk rows between unbounded preceding and 1 preceding) as prev from runs"
ISLANDS = "select *, sum(case when prev is null or start_frame - prev >= 30 then 1 else 0 end) over (partition by video_id order by rk) as island from prevs"
MERGED = """select video_id, cast(island as bigint) as clip_no, min(start_frame) as start_frame, max(end_frame) as end_frame,
 first(category order by coalesce(confidence, 0) desc, rk) as category, first(specific_technique order by coalesce(confidence, 0) desc, rk) as specific_technique,
 first(role order by coalesce(confidence, 0) desc, rk) as role, first(confidence order by coalesce(confidence, 0) desc, rk) as confidence, count(*) as n_clips
 from islands group by video_id, island"""
MERGE = {"ranked": RANKED, "runs": RUNS, "prevs": PREV, "islands": ISLANDS, "merged": MERGED}


def time_sql(frame: str) -> str:
    s = f"(case when fps > 0 then cast(trunc({frame} / fps) as bigint) else 0 end)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"


EVENTS = f"""select m.video_id, row_number() over (partition by m.video_id order by clip_no) as event_index, count(*) over (partition by m.video_id) as total_events,
 {time_sql("start_frame")} as start_time, {time_sql("end_frame")} as end_time, coalesce(role, 'Unknown') as role, coalesce(specific_technique, 'Unknown') as skill_name,
 coalesce(category, 'UNKNOWN') as category, coalesce(confidence, 0.0) as confidence from merged m join v_videos v on m.video_id = v.video_id"""
UUID5 = lambda x: f"substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12)"
KEY = "cast(video_id as varchar) || '|' || cast(event_index as varchar)"


def merged(spark, sf_dir):
    return clips.merge_clips(view(spark, sf_dir, "v_clips"))


def clip_events(spark, sf_dir):
    fps = view(spark, sf_dir, "v_videos").select("video_id", "fps")
    return events.event_ids(events.clip_to_event(merged(spark, sf_dir).join(fps, "video_id")))


@query("select * from merged", **MERGE)
def merge_clips(spark, sf_dir):
    return merged(spark, sf_dir)


#: All clips, frames and events as of one video with two thirds of the rows and others with the rest.
ONE_VIDEO = "case when video_id % 3 <> 0 then 0 else video_id end"
GIANT = "select * replace (" + ONE_VIDEO + " as video_id) from v_clips"


def giant(rows):
    return rows.withColumn("video_id", F.expr(ONE_VIDEO).cast("long"))


def in_pieces(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("select * from merged", **{"giant": GIANT, **MERGE, "ranked": RANKED.replace("v_clips", "giant")})
def merge_giant(spark, sf_dir):
    return clips.merge_clips(giant(view(spark, sf_dir, "v_clips")), pieces=in_pieces(spark))


@query("select video_id, frame from (select *, row_number() over (partition by video_id order by frame) as rn from giant where frame % 2 = 0) where rn <= 1000", giant=GIANT.replace("v_clips", "v_frames"))
def limit_giant(spark, sf_dir):
    return frames.limit_frames(frames.sample_frames(giant(view(spark, sf_dir, "v_frames")), 2), 1000, pieces=in_pieces(spark))


@query(
    """select v.video_id, 'Analysis generated via Single-Agent' as match_summary, fps, count(m.video_id) as n_clips,
 coalesce(string_agg(cast(start_frame as varchar) || '-' || cast(end_frame as varchar) || ':' || category, ',' order by clip_no), '') as clips
 from v_videos v left join merged m on v.video_id = m.video_id group by v.video_id, fps""",
    **MERGE,
)
def result_document(spark, sf_dir):
    docs = clips.result_document(merged(spark, sf_dir), view(spark, sf_dir, "v_videos"))
    text = F.transform("clips", lambda c: F.concat(c["start_frame"].cast("string"), F.lit("-"), c["end_frame"].cast("string"), F.lit(":"), c["category"]))
    return docs.select("video_id", "match_summary", "fps", F.size("clips").cast("long").alias("n_clips"), F.array_join(text, ",").alias("clips"))


@query("select video_id, pos, case when pos % 50 = 0 then 'no start_frame' when pos % 50 = 1 then 'no end_frame' when pos % 50 = 2 then 'confidence is NaN' else 'good' end as verdict from v_clips")
def quarantine_clips(spark, sf_dir):
    k = F.col("pos") % 50
    rows = view(spark, sf_dir, "v_clips").withColumns({"start_frame": F.when(k != 0, F.col("start_frame")), "end_frame": F.when(k != 1, F.col("end_frame")), "confidence": F.when(k == 2, F.lit(float("nan"))).otherwise(F.col("confidence"))})
    good, bad = clips.quarantine_clips(rows)
    return good.select("video_id", "pos", F.lit("good").alias("verdict")).unionByName(bad.select("video_id", "pos", F.col("reason").alias("verdict")))


@query("select * from ev", **MERGE, ev=EVENTS)
def event_times(spark, sf_dir):
    return clip_events(spark, sf_dir).drop("id", "candidate_id")


@query(
    f"""select video_id, event_index as seq, {UUID5(KEY)} as id, {UUID5(KEY + " || '|c'")} as candidate_id, start_time, end_time, skill_name, confidence,
 category, 'bjj_event_detected' as event_type, cast(event_index as varchar) as event_index, cast(total_events as varchar) as total_events from ev""",
    **MERGE,
    ev=EVENTS,
)
def event_messages(spark, sf_dir):
    from reelspark.schemas import EVENT_BODY

    rows = events.event_messages(clip_events(spark, sf_dir)).withColumn("b", F.from_json("body", EVENT_BODY))
    attr = [F.element_at("attributes", k).alias(k) for k in ("category", "event_type", "event_index", "total_events")]
    one = F.get("b.event_candidates", F.lit(0))
    return rows.select("video_id", "seq", "b.id", one["id"].alias("candidate_id"), "b.start_time", "b.end_time", one["skill_name"].alias("skill_name"), one["confidence"].alias("confidence"), *attr)


@query(
    """select v.video_id, count(m.video_id) + 1 as seq, cast(v.video_id as varchar) as job_id, cast(count(m.video_id) as bigint) as total_event_count,
 case when v.video_id % 3 = 0 then null else 's3://out/' || cast(v.video_id as varchar) end as result_s3_uri, 'analysis_complete' as event_type
 from v_videos v left join merged m on v.video_id = m.video_id group by v.video_id""",
    **MERGE,
)
def completion_messages(spark, sf_dir):
    from reelspark.schemas import COMPLETION_BODY

    uri = F.when(F.col("video_id") % 3 == 0, "").otherwise(F.concat(F.lit("s3://out/"), F.col("video_id").cast("string")))
    rows = events.completion_messages(view(spark, sf_dir, "v_videos"), clip_events(spark, sf_dir), uri=uri).withColumn("b", F.from_json("body", COMPLETION_BODY))
    return rows.select("video_id", "seq", "b.job_id", F.col("b.total_event_count").cast("long").alias("total_event_count"), "b.result_s3_uri", F.element_at("attributes", "event_type").alias("event_type"))


@query(
    """select video_id, event_index as seq, 'bjj_event_detected' as event_type from ev
 union all select v.video_id, count(m.video_id) + 1, 'analysis_complete' from v_videos v left join merged m on v.video_id = m.video_id group by v.video_id""",
    **MERGE,
    ev=EVENTS,
)
def all_messages(spark, sf_dir):
    rows = events.all_messages(view(spark, sf_dir, "v_videos"), clip_events(spark, sf_dir))
    return rows.select("video_id", "seq", F.element_at("attributes", "event_type").alias("event_type"))


# ---- frames

@query("select * from v_frames where frame % 5 = 0")
def sample_frames(spark, sf_dir):
    return frames.sample_frames(view(spark, sf_dir, "v_frames"), 5)


@query("select video_id, frame from (select *, row_number() over (partition by video_id order by frame) as rn from v_frames where frame % 2 = 0) where rn <= 40")
def limit_frames(spark, sf_dir):
    return frames.limit_frames(frames.sample_frames(view(spark, sf_dir, "v_frames"), 2), 40)


@query("select f.video_id, f.frame from v_frames f join v_videos v on f.video_id = v.video_id where f.frame >= 0 and f.frame < total_frames")
def readable_prefix(spark, sf_dir):
    return frames.readable_prefix(view(spark, sf_dir, "v_frames"), view(spark, sf_dir, "v_videos"))


def tracking_frames(spark, sf_dir):
    """(video_id, frame, athletes) with empty frames kept."""
    athlete = F.struct(F.col("det_idx").cast("int").alias("track_id"), F.array("x1", "y1", "x2", "y2").alias("box"))
    boxes = view(spark, sf_dir, "v_athletes").groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(athlete)).alias("athletes"))
    rows = view(spark, sf_dir, "v_frames").join(boxes, ["video_id", "frame"], "left")
    return rows.withColumn("athletes", F.coalesce("athletes", F.array().cast(boxes.schema["athletes"].dataType)))


@query("select f.video_id, f.frame, count(a.frame) as n_athletes from v_frames f join v_athletes a on f.video_id = a.video_id and f.frame = a.frame group by f.video_id, f.frame")
def drop_empty_frames(spark, sf_dir):
    return frames.drop_empty_frames(tracking_frames(spark, sf_dir)).select("video_id", "frame", F.size("athletes").cast("long").alias("n_athletes"))


@query(
    """select f.video_id, f.frame, case when f.frame % 7 = 0 then least(count(a.frame), 1) else count(a.frame) end as n_athletes
 from v_frames f left join v_athletes a on f.video_id = a.video_id and f.frame = a.frame group by f.video_id, f.frame"""
)
def last_frame_wins(spark, sf_dir):
    rows = tracking_frames(spark, sf_dir)
    again = rows.where("frame % 7 = 0").withColumn("athletes", F.slice("athletes", 1, 1))
    both = rows.withColumn("turn", F.lit(0)).unionByName(again.withColumn("turn", F.lit(1)))
    docs = both.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "frame", "athletes"))), lambda x: F.struct(x["frame"].alias("frame"), x["athletes"].alias("athletes"))).alias("frames"))
    return frames.explode_frames(docs).select("video_id", "frame", F.size("athletes").cast("long").alias("n_athletes"))


@query("select video_id, i as local_idx, i * 100 as frame from v_videos, unnest(range(0, case when total_frames > 0 then least((total_frames - 1) // 100 + 1, 30) else 0 end)) t(i)")
def frame_sequence(spark, sf_dir):
    return frames.frame_sequence(view(spark, sf_dir, "v_videos"), 100, 30)


@query(
    """select video_id, frame from (select *, row_number() over (partition by video_id order by frame) - 1 as rn, greatest(1, count(*) over (partition by video_id) // 6) as step from v_frames)
 where rn % step = 0 and rn // step < 6"""
)
def evenly_spaced(spark, sf_dir):
    return frames.evenly_spaced(view(spark, sf_dir, "v_frames"), 6)


@query("select video_id, obj_id, frame from (select *, row_number() over (partition by video_id, obj_id order by frame desc) as rn from (select distinct video_id, frame % 5 as obj_id, frame from v_frames)) where rn <= 30")
def retain_latest(spark, sf_dir):
    rows = view(spark, sf_dir, "v_frames").withColumn("obj_id", F.col("frame") % 5)
    return frames.retain_latest(rows.where("frame % 3 <> 0"), rows.where("frame % 3 <> 1"), 30).select("video_id", "obj_id", "frame")


# ---- geometry

UNION = "select video_id, frame, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from v_athletes group by video_id, frame"
SQUARE = [
    "select u.*, v.width, v.height, greatest(x2 - x1, y2 - y1) * (1 + cast(0.2 as double)) as side, x1 + (x2 - x1) / 2 as cx, y1 + (y2 - y1) / 2 as cy from u join v_videos v on u.video_id = v.video_id",
    "select *, cx - side / 2 as l, cy - side / 2 as t, cx + side / 2 as r, cy + side / 2 as b from sq0",
    "select * replace (case when l < 0 then r - l else r end as r, case when l < 0 then 0 else l end as l, case when t < 0 then b - t else b end as b, case when t < 0 then 0 else t end as t) from sq1",
    "select * replace (case when r > width then l - (r - width) else l end as l, case when r > width then width else r end as r, case when b > height then t - (b - height) else t end as t, case when b > height then height else b end as b) from sq2",
    """select video_id, frame, cast(greatest(0, least(width, trunc(l))) as integer) as crop_x1, cast(greatest(0, least(height, trunc(t))) as integer) as crop_y1,
 cast(greatest(0, least(width, trunc(r))) as integer) as crop_x2, cast(greatest(0, least(height, trunc(b))) as integer) as crop_y2 from sq3""",
]
CROPS = {"u": UNION, **{f"sq{i}": q for i, q in enumerate(SQUARE)}}
CROP_COLS = ("video_id", "frame", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


def boxes(spark, sf_dir):
    return geometry.union_box(frames.drop_empty_frames(tracking_frames(spark, sf_dir)))


def crops(spark, sf_dir):
    size = view(spark, sf_dir, "v_videos").select("video_id", "width", "height")
    return geometry.valid_crop(geometry.square_crop(boxes(spark, sf_dir).join(size, "video_id"), 0.2)).select(*CROP_COLS)


@query(UNION)
def union_box(spark, sf_dir):
    return boxes(spark, sf_dir)


@query("select * from sq4 where crop_x2 > crop_x1 and crop_y2 > crop_y1", **CROPS)
def square_crop(spark, sf_dir):
    return crops(spark, sf_dir)


@query(
    """select video_id, frame, 'esrgan' as method, case when greatest(w, h) * 4 > 1024 then cast(trunc(w * 4 * (cast(1024 as double) / (greatest(w, h) * 4))) as integer) else w * 4 end as out_w,
 case when greatest(w, h) * 4 > 1024 then cast(trunc(h * 4 * (cast(1024 as double) / (greatest(w, h) * 4))) as integer) else h * 4 end as out_h from wh
 union all select * from (select video_id, frame, 'diffusion' as method,
 cast(floor((case when greatest(w, h) > 768 then cast(trunc(w * (cast(768 as double) / greatest(w, h))) as integer) else w end) / 8) as integer) * 8 as out_w,
 cast(floor((case when greatest(w, h) > 768 then cast(trunc(h * (cast(768 as double) / greatest(w, h))) as integer) else h end) / 8) as integer) * 8 as out_h from wh) where out_w > 0 and out_h > 0""",
    **CROPS,
    wh="select video_id, frame, crop_x2 - crop_x1 as w, crop_y2 - crop_y1 as h from sq4 where crop_x2 > crop_x1 and crop_y2 > crop_y1",
)
def enhance_plan(spark, sf_dir):
    rows = crops(spark, sf_dir).withColumn("method", F.explode(F.array(F.lit("esrgan"), F.lit("diffusion"))))
    return geometry.enhance_plan(rows, None).select("video_id", "frame", "method", "out_w", "out_h")


@query("select video_id, frame, printf('crops/%sframe_%06d.jpg', 'swinir_', frame) as path from v_frames union all select video_id, frame, printf('crops/%sframe_%06d.jpg', 'esrgan_', frame) from v_frames")
def crop_paths(spark, sf_dir):
    rows = view(spark, sf_dir, "v_frames")
    return geometry.crop_path(rows, "swinir", "crops").unionByName(geometry.crop_path(rows, "other", "crops"))


@query(
    """select a.video_id, frame, det_idx, least(width, greatest(0, cast(trunc(x1) as integer))) as x1, least(height, greatest(0, cast(trunc(y1) as integer))) as y1,
 least(width, greatest(0, cast(trunc(x2) as integer))) as x2, least(height, greatest(0, cast(trunc(y2) as integer))) as y2 from v_athletes a join v_videos v on a.video_id = v.video_id"""
)
def clamp_box(spark, sf_dir):
    size = view(spark, sf_dir, "v_videos").select("video_id", "width", "height")
    return geometry.clamp_box(view(spark, sf_dir, "v_athletes").join(size, "video_id")).drop("width", "height")


@query("select video_id, frame, det_idx, x1, y1, x1 + w as x2, y1 + h as y2 from (select *, case when det_idx = 1 then 0 else x2 - x1 end as w, case when det_idx = 1 then 0 else y2 - y1 end as h from (select * replace (case when det_idx = 1 then 0 else x1 end as x1, case when det_idx = 1 then 0 else y1 end as y1) from v_athletes)) where det_idx <> 1")
def roi_to_box(spark, sf_dir):
    one = F.col("det_idx") == 1
    rows = view(spark, sf_dir, "v_athletes").select(
        "video_id", "frame", "det_idx", *[F.when(one, 0.0).otherwise(c).alias(n) for n, c in (("x", F.col("x1")), ("y", F.col("y1")), ("w", F.col("x2") - F.col("x1")), ("h", F.col("y2") - F.col("y1")))]
    )
    out = geometry.roi_to_box(rows)
    return out.select("video_id", "frame", "det_idx", *[F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("select cast(floor(l_orderkey / 64) as bigint) as video_id, l_orderkey as frame, l_linenumber as track_id, min(l_partkey % 640) as x1, min(l_suppkey % 360) as y1, max(l_partkey % 640) as x2, max(l_suppkey % 360) as y2, count(*) as mask_area from lineitem group by 1, 2, 3")
def mask_bbox(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 64).alias("video_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("track_id"), (F.col("l_partkey") % 640).alias("x"), (F.col("l_suppkey") % 360).alias("y")
    )
    return geometry.mask_bbox(rows)


@query("select cast(floor(l_orderkey / 64) as bigint) as video_id, l_orderkey as frame, l_linenumber as track_id, min(l_partkey % 640) as x1, min(l_suppkey % 360) as y1, max(l_partkey % 640) as x2, max(l_suppkey % 360) as y2, count(distinct (l_suppkey % 360) * 640 + l_partkey % 640) as mask_area from lineitem group by 1, 2, 3")
def mask_runs(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 64).alias("video_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("track_id"), (F.col("l_partkey") % 640).alias("x"), (F.col("l_suppkey") % 360).alias("y")
    )
    return geometry.mask_bbox_runs(geometry.mask_runs(rows, 640))


RUN_PIXELS = "select l_orderkey as frame, l_linenumber as track_id, (l_suppkey % 360) * 640 + l_partkey % 640 as s, cast(l_quantity as bigint) as n from lineitem"


@query(
    """select cast(floor(frame / 64) as bigint) as video_id, frame, track_id, min(p % 640) as x1, min(p // 640) as y1, max(p % 640) as x2, max(p // 640) as y2, count(*) as mask_area from runs, unnest(range(s, s + n)) t(p) group by 1, 2, 3""",
    runs=RUN_PIXELS,
)
def mask_bbox_runs(spark, sf_dir):
    start = (F.col("l_suppkey") % 360) * 640 + F.col("l_partkey") % 640
    rows = read(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 64).alias("video_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("track_id"))
    runs = rows.agg(F.collect_list(F.struct(start.cast("long").alias("s"), F.col("l_quantity").cast("long").alias("n"))).alias("r"))
    return geometry.mask_bbox_runs(runs.select("video_id", "frame", "track_id", F.lit(640).alias("width"), F.col("r.s").alias("starts"), F.col("r.n").alias("lengths")))


@query(
    """select image_id, cast(ty as integer) as tile_y, cast(tx as integer) as tile_x, x1, y1, x2, y2, greatest(x1 - p, 0) as pad_x1, greatest(y1 - p, 0) as pad_y1, least(x2 + p, width) as pad_x2, least(y2 + p, height) as pad_y2,
 x1 * 4 as out_x1, y1 * 4 as out_y1, x2 * 4 as out_x2, y2 * 4 as out_y2, (x1 - greatest(x1 - p, 0)) * 4 as in_x, (y1 - greatest(y1 - p, 0)) * 4 as in_y
 from (select *, tx * tw as x1, ty * tw as y1, least(tx * tw + tw, width) as x2, least(ty * tw + tw, height) as y2 from grid)""",
    img="select p_partkey as image_id, cast(100 + p_partkey % 1500 as integer) as width, cast(100 + p_size * 25 as integer) as height from part",
    plan="select *, case when width > 400 or height > 400 then 400 else greatest(width, height) end as tw, case when width > 400 or height > 400 then 10 else 0 end as p from img",
    grid="select * from plan, unnest(range(0, cast(ceil(height / tw) as bigint))) a(ty), unnest(range(0, cast(ceil(width / tw) as bigint))) b(tx)",
)
def tile_plan(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (100 + F.col("p_partkey") % 1500).cast("int").alias("width"), (100 + F.col("p_size") * 25).cast("int").alias("height"))
    return geometry.tile_plan(rows).drop("width", "height")


# ---- detections and tracking documents

DETS = "select video_id, frame as frame_idx, det_idx, det_idx % 2 as class_id, x1, y1, x2, y2, (frame % 100) / 100 as confidence from v_athletes"


def raw_detections(spark, sf_dir):
    return view(spark, sf_dir, "v_athletes").select(
        "video_id", F.col("frame").alias("frame_idx"), "det_idx", (F.col("det_idx") % 2).alias("class_id"), F.array("x1", "y1", "x2", "y2").alias("box"), ((F.col("frame") % 100) / 100).alias("confidence")
    )


def corner(i: int):
    return F.get("box", F.lit(i))


@query("select video_id, frame_idx, det_idx, round(x2, 1) as x2, round(confidence, 4) as confidence from dets where class_id = 0 and confidence >= 0.5", dets=DETS)
def filter_persons(spark, sf_dir):
    return detections.filter_persons(raw_detections(spark, sf_dir), 0.5).select("video_id", "frame_idx", "det_idx", corner(2).alias("x2"), "confidence")


@query("select video_id, frame_idx, det_idx, row_number() over (partition by video_id, frame_idx order by det_idx) as track_id from dets where class_id = 0 and confidence >= 0.5", dets=DETS)
def number_tracks(spark, sf_dir):
    return detections.number_tracks(detections.filter_persons(raw_detections(spark, sf_dir))).select("video_id", "frame_idx", "det_idx", F.col("track_id").cast("long").alias("track_id"))


@query(
    """select video_id, frame_idx, det_idx, track_id from (select d.video_id, d.frame_idx, d.det_idx, row_number() over (partition by d.video_id order by pick_no, d.det_idx) as track_id, count(*) over (partition by d.video_id) as n
 from (select * from dets join firsts using (video_id, frame_idx)) d join (select video_id, det_idx, min(pick_no) as pick_no from picks group by video_id, det_idx) p on d.video_id = p.video_id and d.det_idx = p.det_idx)
 where n >= 2 and track_id <= 2""",
    dets=DETS,
    firsts="select video_id, max(frame_idx) as frame_idx from dets group by video_id",
    picks="select video_id, i as pick_no, (video_id * 3 + i * 2) % 6 as det_idx from v_videos, unnest(range(0, 8)) t(i)",
)
def apply_picks(spark, sf_dir):
    dets = raw_detections(spark, sf_dir)
    first = dets.groupBy("video_id").agg(F.max("frame_idx").alias("frame_idx"))
    picks = view(spark, sf_dir, "v_videos").select("video_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pick_no")).withColumn("det_idx", (F.col("video_id") * 3 + F.col("pick_no") * 2) % 6)
    out = detections.apply_picks(dets.join(first, ["video_id", "frame_idx"]), picks)
    return out.select("video_id", "frame_idx", "det_idx", F.col("track_id").cast("long").alias("track_id"))


@query(
    """select v.video_id, 'm' || cast(v.video_id as varchar) as video, v.fps, count(*) as n_frames, cast(sum(n) as bigint) as n_athletes, coalesce(cast(first(n order by frame) filter (where n > 0) as bigint), 0) as num_objects,
 string_agg(cast(frame as varchar) || ':' || cast(n as varchar), ',' order by frame) as frames from
 (select f.video_id, f.frame, count(a.frame) as n from v_frames f left join v_athletes a on f.video_id = a.video_id and f.frame = a.frame group by f.video_id, f.frame) x join v_videos v on v.video_id = x.video_id group by v.video_id, v.fps"""
)
def tracking_document(spark, sf_dir):
    docs = tracked(spark, sf_dir)
    n = F.aggregate("frames", F.lit(0).cast("long"), lambda s, f: s + F.size(f["athletes"]))
    text = F.array_join(F.transform("frames", lambda f: F.concat(f["frame"].cast("string"), F.lit(":"), F.size(f["athletes"]).cast("string"))), ",")
    return docs.select("video_id", "video", "fps", F.size("frames").cast("long").alias("n_frames"), n.alias("n_athletes"), F.col("num_objects").cast("long").alias("num_objects"), text.alias("frames"))


def tracked_parts(spark, sf_dir):
    """Frames, tracks and videos; the frame's own number serves as its local index."""
    rows = view(spark, sf_dir, "v_frames").select("video_id", F.col("frame").alias("local_idx"), F.lit(None).cast("long").alias("frame"))
    tracks = view(spark, sf_dir, "v_athletes").select(
        "video_id", F.col("frame").alias("local_idx"), F.col("det_idx").cast("int").alias("track_id"), F.array("x1", "y1", "x2", "y2").alias("box"), F.lit(0).cast("long").alias("mask_area")
    )
    videos = view(spark, sf_dir, "v_videos").withColumn("video", F.concat(F.lit("m"), F.col("video_id").cast("string")))
    return rows, tracks, videos


def tracked(spark, sf_dir):
    rows, tracks, videos = tracked_parts(spark, sf_dir)
    return tracking.tracking_document(tracks, rows, videos)


# ---- windows and responses

@query(
    """select video_id, k + 1 as window_no, k = m as is_final, string_agg(cast(frame as varchar), ',' order by frame) as frames
 from (select *, case when n < 30 then 0 else (n - 30) // 15 + 1 end as m from (select video_id, frame, row_number() over (partition by video_id order by frame) - 1 as rn, count(*) over (partition by video_id) as n from v_frames)) f,
 unnest(range(0, m + 1)) t(k) where (k < m and rn >= k * 15 and rn < k * 15 + 30) or (k = m and rn >= m * 15) group by video_id, k, m"""
)
def sliding_windows(spark, sf_dir):
    rows = windows.sliding_windows(view(spark, sf_dir, "v_frames"))
    return rows.select("video_id", F.col("window_no").cast("long").alias("window_no"), "is_final", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


WINDOWS = """select video_id, k + 1 as window_no, k = m as is_final, count(*) as n, string_agg(cast(frame as varchar), ', ' order by frame) as frames
 from (select *, case when n < 30 then 0 else (n - 30) // 15 + 1 end as m from (select video_id, frame, row_number() over (partition by video_id order by frame) - 1 as rn, count(*) over (partition by video_id) as n from v_frames)) f,
 unnest(range(0, m + 1)) t(k) where (k < m and rn >= k * 15 and rn < k * 15 + 30) or (k = m and rn >= m * 15) group by video_id, k, m"""


@query("select video_id, window_no, case when is_final then 'final' else cast(window_no as varchar) end as \"window\" from win", win=WINDOWS)
def number_windows(spark, sf_dir):
    return windows.number_windows(windows.sliding_windows(view(spark, sf_dir, "v_frames"))).select("video_id", F.col("window_no").cast("long").alias("window_no"), "window")


@query(
    """select video_id, window_no, string_agg(case when role = 'Referee' and turn % 6 = 1 then '--- ' || role || ' FAILED ---' || chr(10) || 'Error: none' || chr(10) else '--- ' || role || ' REPORT ---' || chr(10) || text || chr(10) end, chr(10) order by turn % 3) as report
 from (select conv_id as video_id, turn, turn // 3 as window_no, case turn % 3 when 0 then 'Biomechanist' when 1 then 'Referee' else 'Tactician' end as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null) group by video_id, window_no"""
)
def assemble_reports(spark, sf_dir):
    turn = F.col("turn")
    role = F.when(turn % 3 == 0, "Biomechanist").when(turn % 3 == 1, "Referee").otherwise("Tactician")
    rows = read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    rows = rows.select(F.col("conv_id").alias("video_id"), F.floor(turn / 3).alias("window_no"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.when(turn % 6 == 1, "none").alias("error"))
    return windows.assemble_reports(rows)


BODY = r"""select *, window_no = max(window_no) over (partition by video_id) as is_final, regexp_replace(regexp_replace(case when contains(response, '```json') then split_part(split_part(response, '```json', 2), '```', 1)
 when contains(response, '```') then split_part(response, '```', 2) else response end, '^\s+', ''), '\s+$', '') as body from v_responses"""
PARSED = "select *, case when json_valid(body) then json_type(body) = 'OBJECT' else false end as parse_ok from body"


def parsed(spark, sf_dir):
    from pyspark.sql import Window

    rows = view(spark, sf_dir, "v_responses")
    last = F.max("window_no").over(Window.partitionBy("video_id"))
    return responses.parse_responses(rows.withColumn("is_final", F.col("window_no") == last))


@query("select video_id, window_no, body from body", body=BODY)
def strip_fences(spark, sf_dir):
    return view(spark, sf_dir, "v_responses").select("video_id", "window_no", responses.strip_fences("response").alias("body"))


@query(
    """select video_id, window_no, parse_ok, case when parse_ok then json_extract_string(body, '$.current_context_summary') end as summary, case when parse_ok then json_extract_string(body, '$.error') end as error,
 case when parse_ok then cast(json_array_length(body, '$.clips') as bigint) end as n_clips, case when not parse_ok then response end as raw_error from parsed where parse_ok or not is_final""",
    body=BODY,
    parsed=PARSED,
)
def parse_responses(spark, sf_dir):
    a = "analysis"
    rows = parsed(spark, sf_dir)
    n = F.when(F.col(f"{a}.clips").isNotNull(), F.size(f"{a}.clips")).cast("long")
    return rows.select("video_id", "window_no", "parse_ok", F.col(f"{a}.current_context_summary").alias("summary"), F.col(f"{a}.error").alias("error"), n.alias("n_clips"), "raw_error")


@query(
    """select video_id, window_no, cast(i as integer) as idx, cast(json_extract(body, '$.clips[' || i || '].start_frame') as bigint) as start_frame, cast(json_extract(body, '$.clips[' || i || '].end_frame') as bigint) as end_frame,
 json_extract_string(body, '$.clips[' || i || '].category') as category, cast(json_extract(body, '$.clips[' || i || '].confidence') as double) as confidence
 from (select * from parsed where parse_ok), unnest(range(0, coalesce(cast(json_array_length(body, '$.clips') as bigint), 0))) t(i)""",
    body=BODY,
    parsed=PARSED,
)
def explode_clips(spark, sf_dir):
    return clips.explode_clips(parsed(spark, sf_dir)).select("video_id", "pos.window_no", "pos.idx", "start_frame", "end_frame", "category", "confidence")


CONTEXT = """select p.video_id, p.window_no, case when p.src is null then 'Start of match.' else json_extract_string(q.body, '$.current_context_summary') end as context
 from (select *, last_value(case when has then window_no end ignore nulls) over (partition by video_id order by window_no rows between unbounded preceding and 1 preceding) as src from keyed) p
 left join keyed q on p.video_id = q.video_id and p.src = q.window_no"""
KEYED = "select *, case when parse_ok then list_contains(json_keys(body), 'current_context_summary') else false end as has from parsed where parse_ok or not is_final"


@query(CONTEXT, body=BODY, parsed=PARSED, keyed=KEYED)
def carry_context(spark, sf_dir):
    return responses.carry_context(parsed(spark, sf_dir)).select("video_id", "window_no", "context")


# ---- the consumer's side

@query("select video_id, event_type, event_index, category from v_messages where event_type = 'bjj_event_detected' and category in ('click', 'view') union all select video_id, event_type, event_index, category from v_messages where category is null")
def filter_policy(spark, sf_dir):
    rows = view(spark, sf_dir, "v_messages")
    some = events.filter_policy(rows, {"event_type": ["bjj_event_detected"], "category": ["click", "view"]})
    return some.unionByName(events.filter_policy(rows, {"category": [{"exists": False}]})).select("video_id", "event_type", "event_index", "category")


@query("select distinct video_id, event_type, event_index, id from v_messages")
def dedupe_messages(spark, sf_dir):
    return events.dedupe_messages(view(spark, sf_dir, "v_messages")).select("video_id", "event_type", "event_index", "id")


@query(
    """select video_id, event_index, id, category from (select *, row_number() over (partition by video_id, event_index order by ts desc, id desc) as rn
 from (select video_id, event_index % 50 as event_index, id, category, ts from v_messages where event_index is not null)) where rn = 1"""
)
def upsert_events(spark, sf_dir):
    rows = view(spark, sf_dir, "v_messages").where("event_index is not null").select("video_id", (F.col("event_index") % 50).alias("event_index"), "id", "category", "ts")
    return events.upsert_events(rows, order=("ts", "id")).select("video_id", "event_index", "id", "category")


STATUS = """select video_id, count(distinct case when event_type = 'bjj_event_detected' then event_index end) as received_count, bool_or(event_type = 'analysis_complete') as completion_received,
 coalesce(max(case when event_type = 'analysis_complete' then total_events end), max(total_events)) as expected_total from v_messages group by video_id"""


@query(STATUS)
def video_status(spark, sf_dir):
    return events.video_status(view(spark, sf_dir, "v_messages"))


@query("select * from status where completion_received and received_count >= expected_total", status=STATUS)
def finalised_videos(spark, sf_dir):
    return events.finalise(events.video_status(view(spark, sf_dir, "v_messages")))


FEED = f"""select cast(video_id as varchar) as video_id, 'bjj_event_detected' as event_type, event_index, total_events, category, {UUID5(KEY)} as id, start_time, cast(null as varchar) as job_id, cast(null as varchar) as result_s3_uri from ev
 union all select cast(v.video_id as varchar), 'analysis_complete', null, count(m.video_id), null, null, null, 'job-' || cast(v.video_id as varchar), case when v.video_id % 3 = 0 then null else 's3://out/' || cast(v.video_id as varchar) end
 from v_videos v left join merged m on v.video_id = m.video_id group by v.video_id"""
#: Every seventh event message is lost and every fifth comes twice.
LOSSY = "select * from feed where event_index is null or event_index % 7 <> 0"
FEED_STATUS = """select video_id, count(event_index) as received_count, bool_or(event_type = 'analysis_complete') as completion_received, max(total_events) as expected_total, max(job_id) as job_id, max(result_s3_uri) as result_s3_uri,
 count(event_index) >= max(total_events) and bool_or(event_type = 'analysis_complete') as finalized from lossy group by video_id"""
STREAM = {**MERGE, "ev": EVENTS, "feed": FEED, "lossy": LOSSY}


def published(spark, sf_dir):
    """All messages as a subscriber gets them: JSON texts of envelopes."""
    name = F.col("video_id").cast("string")
    uri = F.when(F.col("video_id") % 3 == 0, "").otherwise(F.concat(F.lit("s3://out/"), name))
    return events.all_messages(view(spark, sf_dir, "v_videos").select("video_id"), clip_events(spark, sf_dir), F.concat(F.lit("job-"), name), uri)


def delivered(spark, sf_dir) -> str:
    """A folder of the feed as it is delivered: some messages lost, some twice."""
    rows = published(spark, sf_dir).withColumn("index", F.element_at("attributes", "event_index").cast("long"))
    rows = rows.where("index is null or index % 7 <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("seq") % 5 == 0, 2).otherwise(1))))
    path = scratch(spark, "feed")
    events.enveloped(rows.drop("index", "copy"), F.timestamp_seconds(F.col("seq"))).write.text(path)
    return path


def message_columns(rows):
    return rows.select("video_id", "event_type", "event_index", "total_events", "category", "event.id", "event.start_time", "completion.job_id", "completion.result_s3_uri")


@query("select * from feed", **STREAM)
def parse_envelope(spark, sf_dir):
    from reelspark.schemas import ENVELOPE

    texts = events.enveloped(published(spark, sf_dir))
    return message_columns(events.parse_envelope(texts.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")))


@query("select * from lossy union all select * from lossy where coalesce(event_index, total_events + 1) % 5 = 0", **STREAM)
def read_messages(spark, sf_dir):
    return message_columns(events.parse_envelope(readers.read_messages(spark, delivered(spark, sf_dir))))


@query("select distinct * from lossy", **STREAM)
def dedupe_by_index(spark, sf_dir):
    rows = events.parse_envelope(readers.read_messages(spark, delivered(spark, sf_dir)))
    return message_columns(events.dedupe_messages(rows, ("video_id", "event_type", "event_index")))


@query("select * exclude (finalized) from status", **STREAM, status=FEED_STATUS)
def message_status(spark, sf_dir):
    rows = events.parse_envelope(readers.read_messages(spark, delivered(spark, sf_dir)))
    return events.video_status(rows).drop("created_at", "updated_at")


@query("select * exclude (finalized) from status where finalized", **STREAM, status=FEED_STATUS)
def finalised_messages(spark, sf_dir):
    return events.finalise(message_status(spark, sf_dir))


@query("select * from status", **STREAM, status=FEED_STATUS)
def upsert_status(spark, sf_dir):
    feed, path = delivered(spark, sf_dir), scratch(spark, "status")
    status.run_status_stream(events.parse_envelope(readers.read_messages(spark, feed, streaming=True)), path, f"{path}/checkpoint")
    return status.read_status(spark, path).drop("created_at", "updated_at")


@query("select video_id, received_count, expected_total, job_id, result_s3_uri from status where finalized", **STREAM, status=FEED_STATUS)
def finalised_stream(spark, sf_dir):
    feed, path = delivered(spark, sf_dir), scratch(spark, "finalised")
    finalised.run_finalised_stream(events.parse_envelope(readers.read_messages(spark, feed, streaming=True)), path, f"{path}-checkpoint")
    return spark.read.schema(finalised.OUTPUT).parquet(path)


# ---- sources and sinks: what is written and read again

@query("select f.video_id, 'm' || cast(f.video_id as varchar) as video, f.frame, count(a.frame) as n_athletes, coalesce(sum(a.x1), 0.0) as x1 from v_frames f left join v_athletes a on f.video_id = a.video_id and f.frame = a.frame group by f.video_id, f.frame")
def write_tracking(spark, sf_dir):
    path = scratch(spark, "tracking")
    sinks.write_tracking(tracked(spark, sf_dir), path)
    docs = readers.read_tracking(spark, path, packed=True).select(F.col("video_id").cast("long").alias("video_id"), "video", F.explode("frames").alias("f"))
    return docs.select("video_id", "video", "f.frame", F.size("f.athletes").cast("long").alias("n_athletes"), F.aggregate("f.athletes", F.lit(0.0), lambda s, a: s + F.get(a["box"], F.lit(0))).alias("x1"))


def frame_columns(rows):
    return rows.select(F.col("video_id").cast("long").alias("video_id"), "frame", F.size("athletes").cast("long").alias("n_athletes"), F.aggregate("athletes", F.lit(0.0), lambda s, a: s + F.get(a["box"], F.lit(0))).alias("x1"))


@query("select f.video_id, f.frame, count(a.frame) as n_athletes, coalesce(sum(a.x1), 0.0) as x1 from v_frames f left join v_athletes a on f.video_id = a.video_id and f.frame = a.frame group by f.video_id, f.frame")
def tracking_fragments(spark, sf_dir):
    path = scratch(spark, "fragments")
    rows, tracks, videos = tracked_parts(spark, sf_dir)
    sinks.write_tracking(tracking.tracking_fragments(tracks, rows, videos), path)
    return frame_columns(readers.read_tracking_frames(spark, path, packed=True))


@query("select floor(f.video_id / 256) as video_id, f.frame, count(a.frame) as n_athletes, coalesce(sum(a.x1), 0.0) as x1 from v_frames f left join v_athletes a on f.video_id = a.video_id and f.frame = a.frame group by floor(f.video_id / 256), f.frame")
def read_tracking_frames(spark, sf_dir):
    path, long = scratch(spark, "long"), F.floor(F.col("video_id") / 256).alias("video_id")
    rows, tracks, videos = tracked_parts(spark, sf_dir)
    rows, tracks = (x.withColumn("video_id", long) for x in (rows, tracks))
    docs = tracking.tracking_document(tracks, rows, videos.select(long, "width", "height", "fps").dropDuplicates(["video_id"]))
    docs.select("video_id", F.to_json(F.struct("video", "model", "fps", "video_size", "num_objects", "frames")).alias("value")).write.partitionBy("video_id").text(path)
    return frame_columns(frames.last_frames(readers.read_tracking_frames(spark, path)))


@query("select video_id, 'm' || cast(video_id as varchar) as video, '1920x1080' as video_size, frame_idx, row_number() over (partition by video_id, frame_idx order by det_idx) as track_id, round(x2, 1) as x2, round(confidence, 4) as confidence from dets where class_id = 0 and confidence >= 0.5", dets=DETS)
def write_detections(spark, sf_dir):
    path = scratch(spark, "detections")
    rows = detections.number_tracks(detections.filter_persons(raw_detections(spark, sf_dir)))
    sinks.write_detections(rows.withColumns({"video": F.concat(F.lit("m"), F.col("video_id").cast("string")), "video_size": F.array(F.lit(1920), F.lit(1080))}), path)
    docs = readers.read_detections(spark, path, packed=True)
    size = F.array_join(F.col("video_size").cast("array<string>"), "x")
    people = readers.explode_persons(docs).join(docs.select("video_id", "frame_idx", "video", size.alias("video_size")), ["video_id", "frame_idx"])
    return people.select(F.col("video_id").cast("long").alias("video_id"), "video", "video_size", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("track_id").cast("long").alias("track_id"), corner(2).alias("x2"), "confidence")


@query("select video_id, window_no, is_final, response from body", body=BODY)
def read_responses(spark, sf_dir):
    path, last = scratch(spark, "responses"), F.max("window_no").over(Window.partitionBy("video_id"))
    view(spark, sf_dir, "v_responses").withColumn("is_final", F.col("window_no") == last).write.json(path)
    return readers.read_responses(spark, path).select("video_id", F.col("window_no").cast("long").alias("window_no"), "is_final", "response")


@query("select video_id, sampling_rate, analyzer_mode, method, video_s3_bucket, output_s3_key from v_requests")
def read_job_requests(spark, sf_dir):
    path = scratch(spark, "requests")
    view(spark, sf_dir, "v_requests").write.json(path)
    return readers.read_job_requests(spark, path).select("video_id", "sampling_rate", "analyzer_mode", "method", "video_s3_bucket", "output_s3_key")


#: Put into every answer: keys that nobody asked for, a null, and a value of another type than expected. {} are the window's number and its rest by 7.
MORE_KEYS = ('"mood":{"calm":[true,null,', ']},"note":null,"clips":[{"score_delta":', ',"role":null,"reasoning":5,')
MORE_SQL = "'" + MORE_KEYS[0] + "' || cast(window_no as varchar) || '" + MORE_KEYS[1] + "' || cast(window_no % 7 as varchar) || '" + MORE_KEYS[2] + "'"
KEYED_RESPONSES = f"""select video_id, window_no, is_final, parse_ok, replace(response, '"clips":[{{', {MORE_SQL}) as response, case when parse_ok then cast(replace(body, '"clips":[{{', {MORE_SQL}) as json) end as a from parsed"""


def keyed_responses(spark, sf_dir):
    """The parsed answers with more keys in them and in their clips."""
    n = F.col("window_no")
    more = F.concat(F.lit(MORE_KEYS[0]), n.cast("string"), F.lit(MORE_KEYS[1]), (n % 7).cast("string"), F.lit(MORE_KEYS[2]))
    last = F.max("window_no").over(Window.partitionBy("video_id"))
    rows = view(spark, sf_dir, "v_responses").withColumn("is_final", n == last)
    return responses.parse_responses(rows.withColumn("response", F.replace("response", F.lit('"clips":[{'), more)))


#: An answer's values under their keys, as one text in which every value shows its kind.
ANSWER = """json_extract_string(a, '$.current_context_summary') as summary, json_type(a, '$.current_context_summary') as summary_kind, cast(json_extract(a, '$.mood') as varchar) as mood, json_type(a, '$.note') as note_kind,
 cast(json_extract(a, '$.clips[0].score_delta') as bigint) as score_delta, json_type(a, '$.clips[0].role') as role_kind, cast(json_extract(a, '$.clips[0].reasoning') as bigint) as reasoning, json_extract_string(a, '$.clips[0].category') as category, cast(json_extract(a, '$.clips[0].confidence') as double) as confidence, cast(json_array_length(a, '$.clips') as bigint) as n_clips"""


def answer_columns(a):
    """The same from a VARIANT."""
    at = lambda path, kind: F.try_variant_get(a, path, kind)
    kind = lambda path: F.schema_of_variant(F.variant_get(a, path, "variant"))
    named = lambda k: F.when(k == "VOID", "NULL").when(k == "STRING", "VARCHAR").otherwise(k)
    n = F.size(at("$.clips", "array<variant>")).cast("long")
    return {
        "summary": at("$.current_context_summary", "string"), "summary_kind": named(kind("$.current_context_summary")), "mood": F.to_json(F.variant_get(a, "$.mood", "variant")), "note_kind": named(kind("$.note")),
        "score_delta": at("$.clips[0].score_delta", "long"), "role_kind": named(kind("$.clips[0].role")), "reasoning": at("$.clips[0].reasoning", "long"), "category": at("$.clips[0].category", "string"),
        "confidence": at("$.clips[0].confidence", "double"), "n_clips": F.when(at("$.clips", "array<variant>").isNotNull(), n),
    }


@query(
    f"""select video_id, case when is_final then 'final' else cast(window_no as varchar) end as "window", case when not parse_ok then response end as raw_error, {ANSWER} from keyed_responses where parse_ok or not is_final""",
    body=BODY,
    parsed=PARSED,
    keyed_responses=KEYED_RESPONSES,
)
def write_raw(spark, sf_dir):
    path = scratch(spark, "raw")
    sinks.write_raw(responses.raw_records(keyed_responses(spark, sf_dir)), path)
    log = packed.read_packed(spark, path).select(F.col("video_id").cast("long").alias("video_id"), F.explode(F.variant_get(F.parse_json("document"), "$", "array<variant>")).alias("r"))
    whole = {"window": F.variant_get("r", "$.window", "string"), "raw_error": F.variant_get("r", "$.raw_error", "string")}
    return log.select("video_id", *[v.alias(k) for k, v in (whole | answer_columns(F.variant_get("r", "$.analysis", "variant"))).items()])


@query(
    f"""select video_id, window_no, case when is_final then 'final' else cast(window_no as varchar) end as "window", parse_ok as has_analysis, {ANSWER} from keyed_responses where parse_ok or not is_final""",
    body=BODY,
    parsed=PARSED,
    keyed_responses=KEYED_RESPONSES,
)
def raw_records(spark, sf_dir):
    rows = responses.raw_records(keyed_responses(spark, sf_dir)).withColumn("a", F.parse_json("analysis_json"))
    return rows.select("video_id", "window_no", "window", F.col("analysis").isNotNull().alias("has_analysis"), *[v.alias(k) for k, v in answer_columns(F.col("a")).items()])


@query(
    """select v.video_id, 'Analysis generated via Single-Agent' as match_summary, fps, clip_no, m.start_frame, m.end_frame, m.category, cast(m.pos as bigint) as pos, case when m.pos is not null then 'NULL' end as why_kind, case when m.pos is not null then '["a",' || cast(m.pos % 3 as varchar) || ']' end as tags
 from v_videos v left join (select video_id, cast(island as bigint) as clip_no, min(start_frame) as start_frame, max(end_frame) as end_frame, first(category order by coalesce(confidence, 0) desc, rk) as category, first(pos order by coalesce(confidence, 0) desc, rk) as pos from islands group by video_id, island) m on v.video_id = m.video_id""",
    **{k: v for k, v in MERGE.items() if k != "merged"},
)
def write_result(spark, sf_dir):
    path = scratch(spark, "results")
    text = F.concat(
        F.lit('{"start_frame":'), F.col("start_frame").cast("string"), F.lit(',"end_frame":'), F.col("end_frame").cast("string"), F.lit(',"category":"'), F.col("category"),
        F.lit('","pos":'), F.col("pos").cast("string"), F.lit(',"why":null,"tags":["a",'), (F.col("pos") % 3).cast("string"), F.lit("]}"),
    )
    free = view(spark, sf_dir, "v_clips").withColumn("clip", F.parse_json(text))
    sinks.write_result(clips.result_document(clips.merge_clips(free), view(spark, sf_dir, "v_videos")), path)
    doc = packed.read_packed(spark, path).select(F.col("video_id").cast("long").alias("video_id"), F.parse_json("document").alias("d"))
    doc = doc.select("video_id", F.variant_get("d", "$.match_summary", "string").alias("match_summary"), F.variant_get("d", "$.fps", "double").alias("fps"), F.posexplode_outer(F.variant_get("d", "$.clips", "array<variant>")).alias("at", "c"))
    at = lambda k, kind: F.variant_get("c", f"$.{k}", kind).alias(k)
    kind = F.schema_of_variant(F.variant_get("c", "$.why", "variant"))
    return doc.select("video_id", "match_summary", "fps", (F.col("at") + 1).cast("long").alias("clip_no"), at("start_frame", "long"), at("end_frame", "long"), at("category", "string"), at("pos", "long"), F.when(kind == "VOID", "NULL").alias("why_kind"), F.to_json(F.variant_get("c", "$.tags", "variant")).alias("tags"))


@query(f"select cast(video_id as varchar) as key, {UUID5(KEY)} as id, category, cast(event_index as varchar) as event_index from ev", **MERGE, ev=EVENTS)
def write_messages(spark, sf_dir):
    path = scratch(spark, "messages")
    sinks.write_messages(events.event_messages(clip_events(spark, sf_dir)), path)
    header = lambda k: F.get(F.filter("headers", lambda h: h["key"] == k), F.lit(0))["value"].cast("string")
    return spark.read.parquet(path).select("key", F.get_json_object("value", "$.id").alias("id"), header("category").alias("category"), header("event_index").alias("event_index"))


# ---- identity

#: A video has the 256 vectors whose ids follow one another.
GALLERY = "select vec_id // 256 as video_id, label as track_id, min(vec_id) as g_id from embeddings where label is not null group by 1, 2"
LOOK = "select vec_id, label, cast(embedding as double[]) as f, list_transform(embedding[1:32], lambda x: abs(cast(x as double))) as h from embeddings where label is not null"
PAIRS = """select c.vec_id // 4 as frame, c.vec_id % 4 as cand_idx, g.track_id, list_dot_product(c.f, e.f) as d, list_dot_product(c.h, e.h) as ab, list_dot_product(c.h, c.h) as aa, list_dot_product(e.h, e.h) as bb,
 list_sum(c.h) as sa, list_sum(e.h) as sb from look c join gallery g on g.video_id = c.vec_id // 256 and c.vec_id not in (select g_id from gallery) join look e on e.vec_id = g.g_id"""
SCORES = """select frame, cand_idx, track_id, (d + 1) / 2 as cosine, case when (aa - sa * sa / 32) * (bb - sb * sb / 32) > 1e-18 then greatest(0.0, (ab - sa * sb / 32) / sqrt((aa - sa * sa / 32) * (bb - sb * sb / 32))) else 1.0 end as hist from pairs"""
LOOKS = {"gallery": GALLERY, "look": LOOK, "pairs": PAIRS, "scores": SCORES}


def video_of_vector():
    return F.floor(F.col("vec_id") / 256)


def looks(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").where("label is not null")
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"), F.transform(F.slice("embedding", 1, 32), lambda x: F.abs(x.cast("double"))).alias("histogram"))


def gallery_and_candidates(spark, sf_dir):
    rows = looks(spark, sf_dir)
    entries = reid.build_gallery(rows.select(video_of_vector().alias("video_id"), F.col("label").alias("track_id"), "features", "histogram", (-F.col("vec_id")).alias("seq"), "vec_id"))
    cands = rows.join(entries.select("vec_id"), "vec_id", "left_anti")
    cands = cands.select(video_of_vector().alias("video_id"), F.floor(F.col("vec_id") / 4).alias("frame"), (F.col("vec_id") % 4).alias("cand_idx"), "features", "histogram", "label", "vec_id")
    return entries.drop("vec_id"), cands


@query("select frame, cand_idx, track_id, round(cosine, 6) as score from scores", **LOOKS)
def cosine_scores(spark, sf_dir):
    g, c = gallery_and_candidates(spark, sf_dir)
    rows = reid.in_blocks(c, g, ("track_id", "features"))
    return rows.select("frame", "cand_idx", "g.track_id", F.round(cosine01("features", "g.features"), 6).alias("score"))


@query("select frame, cand_idx, track_id, round(hist, 6) as score from scores", **LOOKS)
def hist_scores(spark, sf_dir):
    g, c = gallery_and_candidates(spark, sf_dir)
    rows = reid.in_blocks(c, g, ("track_id", "histogram"))
    return rows.select("frame", "cand_idx", "g.track_id", F.round(hist_correlation("histogram", "g.histogram"), 6).alias("score"))


@query("select frame, cand_idx, track_id, round(0.5 * cosine + 0.5 * hist, 6) as score from scores", **LOOKS)
def appearance_scores(spark, sf_dir):
    g, c = gallery_and_candidates(spark, sf_dir)
    return reid.score_matrix(c, g).select("frame", "cand_idx", "track_id", F.round("score", 6).alias("score"))


GREEDY = {
    "sc": "select frame, cand_idx, track_id, 0.5 * cosine + 0.5 * hist as score from scores",
    "ranked": "select *, row_number() over (partition by frame order by score desc, track_id, cand_idx) as k from sc where score > 0.5",
    "run": """select distinct frame, cast(0 as bigint) as k, cast([] as integer[]) as g, cast([] as bigint[]) as c from ranked
 union all select r.frame, x.k, case when list_contains(r.g, x.track_id) or list_contains(r.c, x.cand_idx) then r.g else list_append(r.g, x.track_id) end,
 case when list_contains(r.g, x.track_id) or list_contains(r.c, x.cand_idx) then r.c else list_append(r.c, x.cand_idx) end from run r join ranked x on x.frame = r.frame and x.k = r.k + 1""",
    "took": "select frame, unnest(g) as track_id, unnest(c) as cand_idx from (select frame, arg_max(g, k) as g, arg_max(c, k) as c from run group by frame)",
}


@query(
    """select a.frame // 64 as video_id, a.frame, a.cand_idx, coalesce(t.track_id, -1) as track_id, coalesce(round(sc.score, 6), 0.0) as score from (select distinct frame, cand_idx from sc) a
 left join took t on t.frame = a.frame and t.cand_idx = a.cand_idx left join sc on sc.frame = a.frame and sc.cand_idx = a.cand_idx and sc.track_id = t.track_id""",
    **LOOKS,
    **GREEDY,
)
def greedy_assign(spark, sf_dir):
    g, c = gallery_and_candidates(spark, sf_dir)
    return reid.greedy_assign(reid.score_matrix(c, g), c, 0.5).withColumn("score", F.round("score", 6))


@query(
    """select a.frame, a.label as a, b.label as b, (0.5 * sab.cosine + 0.5 * sab.hist) > (0.5 * saa.cosine + 0.5 * saa.hist) and (0.5 * sba.cosine + 0.5 * sba.hist) > (0.5 * sbb.cosine + 0.5 * sbb.hist) as swapped
 from (select * from two where rn = 1) a join (select * from two where rn = 2) b on a.frame = b.frame
 join scores saa on saa.frame = a.frame and saa.cand_idx = a.cand_idx and saa.track_id = a.label join scores sab on sab.frame = a.frame and sab.cand_idx = a.cand_idx and sab.track_id = b.label
 join scores sba on sba.frame = a.frame and sba.cand_idx = b.cand_idx and sba.track_id = a.label join scores sbb on sbb.frame = a.frame and sbb.cand_idx = b.cand_idx and sbb.track_id = b.label""",
    **LOOKS,
    two="select *, row_number() over (partition by frame order by label) as rn from (select vec_id // 4 as frame, label, min(vec_id % 4) as cand_idx from look where vec_id not in (select g_id from gallery) group by 1, 2)",
)
def detect_swaps(spark, sf_dir):
    g, c = gallery_and_candidates(spark, sf_dir)
    one = c.groupBy("video_id", "frame", F.col("label").alias("track_id")).agg(F.min_by(F.struct("features", "histogram"), "cand_idx").alias("s"))
    return reid.detect_swaps(one.select("video_id", "frame", "track_id", "s.*"), g).drop("video_id")


@query(
    """select frame, string_agg(printf('%.4f', case when hi > lo then (n - lo) / (hi - lo) else 0 end), ',' order by bin) as histogram from
 (select *, min(n) over (partition by frame) as lo, max(n) over (partition by frame) as hi from
 (select f.frame, b.bin, coalesce(c.n, 0) as n from (select distinct l_orderkey // 8 as frame from lineitem) f cross join (select unnest(range(0, 32)) as bin) b
 left join (select l_orderkey // 8 as frame, cast(floor((l_partkey % 180) / 22.5) * 4 + floor(((l_suppkey * 7) % 256) / 64) as bigint) as bin, count(*) as n from lineitem group by 1, 2) c on c.frame = f.frame and c.bin = b.bin)) group by frame"""
)
def hs_histogram(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("frame"), (F.col("l_partkey") % 180).alias("h"), (F.col("l_suppkey") * 7 % 256).alias("s"))
    out = reid.hs_histogram(rows, ("frame",))
    return out.select("frame", F.array_join(F.transform("histogram", lambda x: F.format_string("%.4f", x)), ",").alias("histogram"))


# ---- jobs

@query(
    """select job_id, video_id, case when sampling_rate is null then 1 else cast(sampling_rate as bigint) end as sampling_rate, coalesce(analyzer_mode, 'single') as analyzer_mode, coalesce(method, 'esrgan') as method,
 concat_ws(',', case when video_s3_bucket is null then 'video_s3_bucket missing' end, case when tracking_json_s3_key is null then 'tracking_json_s3_key missing' end, case when video_id = 'bad-id' then 'video_id not a uuid' end, case when cast(sampling_rate as bigint) < 1 then 'sampling_rate' end, case when analyzer_mode = 'both' then 'analyzer_mode' end) as errors from v_requests"""
)
def validate_requests(spark, sf_dir):
    out = jobs.validate_requests(view(spark, sf_dir, "v_requests"))
    return out.select("job_id", "video_id", F.col("sampling_rate").cast("long").alias("sampling_rate"), "analyzer_mode", "method", F.array_join("errors", ",").alias("errors"))


TYPED = """select job_id, r, json_type(r, '$.video_id') as video_kind, json_extract_string(r, '$.video_id') as video, json_type(r, '$.video_s3_bucket') as bucket_kind, json_type(r, '$.sampling_rate') as rate_kind,
 json_type(r, '$.analyzer_mode') as mode_kind, json_type(r, '$.method') as method_kind, json_type(r, '$.sns_topic_arn') as topic_kind, try_cast(json_extract_string(r, '$.sampling_rate') as double) as rate from (select job_id, cast(request as json) as r from v_request_texts)"""


@query(
    """select job_id, case when video_kind = 'VARCHAR' then lower(replace(replace(video, '{', ''), '}', '')) end as video_id, case when rate_kind is null then 1 when rate = floor(rate) then cast(rate as bigint) end as sampling_rate,
 case when mode_kind is null then 'single' when mode_kind = 'VARCHAR' then json_extract_string(r, '$.analyzer_mode') end as analyzer_mode, case when method_kind is null then 'esrgan' when method_kind = 'VARCHAR' then json_extract_string(r, '$.method') end as method,
 concat_ws(',', case when video_kind = 'NULL' then 'video_id missing' when video_kind <> 'VARCHAR' then 'video_id not text' end, case when coalesce(bucket_kind, 'NULL') = 'NULL' then 'video_s3_bucket missing' when bucket_kind <> 'VARCHAR' then 'video_s3_bucket not text' end,
 case when video = 'bad-id' then 'video_id not a uuid' end, case when topic_kind not in ('NULL', 'VARCHAR') then 'sns_topic_arn' end, case when rate_kind is not null and not coalesce(rate = floor(rate) and rate >= 1, false) then 'sampling_rate' end,
 case when mode_kind is not null and not (mode_kind = 'VARCHAR' and json_extract_string(r, '$.analyzer_mode') in ('single', 'multi')) then 'analyzer_mode' end, case when method_kind is not null and method_kind <> 'VARCHAR' then 'method' end) as errors from typed""",
    typed=TYPED,
)
def request_kinds(spark, sf_dir):
    path = scratch(spark, "texts")
    view(spark, sf_dir, "v_request_texts").select(F.col("request").alias("value")).write.text(path)
    out = jobs.validate_requests(readers.read_job_requests(spark, path).withColumn("job_id", F.variant_get("request", "$.job", "long")))
    return out.select("job_id", "video_id", "sampling_rate", "analyzer_mode", "method", F.array_join("errors", ",").alias("errors"))


STATE = """select j.job_id, coalesce(u.status, 'queued') as status, coalesce(u.progress, 0.0) as progress, coalesce(u.message, '') as message, u.error from (select video_id as job_id from v_videos where video_id % 3 <> 0 union all select -1) j
 left join (select job_id, arg_max(status, seq) as status, arg_max(progress, seq) as progress, arg_max(message, seq) as message, arg_max(error, seq) as error from v_updates group by job_id) u on j.job_id = u.job_id"""


@query(STATE)
def job_state(spark, sf_dir):
    known = view(spark, sf_dir, "v_videos").where("video_id % 3 <> 0").select(F.col("video_id").alias("job_id")).union(spark.range(-1, 0))
    return jobs.job_state(known, view(spark, sf_dir, "v_updates")).select("job_id", "status", "progress", "message", "error")


@query("select i.job_id, s.status, s.job_id is not null as found from (select video_id as job_id from v_videos) i left join state s on i.job_id = s.job_id", state=STATE)
def get_jobs(spark, sf_dir):
    ids = view(spark, sf_dir, "v_videos").select(F.col("video_id").alias("job_id"))
    return jobs.get_jobs(job_state(spark, sf_dir), ids).select("job_id", "status", "found")


@query(
    """select video_id, frame, cast(0.1 as double) + pct * cast(0.7 as double) as progress, 'Processing (' || cast(cast(round_even(pct * 100, 0) as integer) as varchar) || '%)' as message from
 (select video_id, frame, row_number() over (partition by video_id order by frame) / count(*) over (partition by video_id) as pct from v_frames) where frame % 9 <> 0"""
)
def stage_progress(spark, sf_dir):
    rows = view(spark, sf_dir, "v_frames").withColumn("skipped", F.col("frame") % 9 == 0)
    return jobs.stage_progress(rows).select("video_id", "frame", "progress", "message")


@query("select v.video_id, printf('Completed. %d clips detected, %d events published.', count(m.video_id), case when v.video_id % 2 = 0 then 0 else count(m.video_id) end) as message from v_videos v left join merged m on v.video_id = m.video_id group by v.video_id", **MERGE)
def completion_text(spark, sf_dir):
    return jobs.completion_text(view(spark, sf_dir, "v_videos").select("video_id"), merged(spark, sf_dir), F.col("video_id") % 2 != 0).select("video_id", "message")


@query("select r.job_id, r.video, case when v.video_id is null then 'failed' else 'completed' end as status, case when v.video_id is not null then coalesce(v.fps, 30.0) end as fps from (select job_id, job_id // 64 as video from v_requests) r left join (select video_id, case when video_id % 4 = 0 then null else fps end as fps from v_videos) v on r.video = v.video_id")
def completed_jobs(spark, sf_dir):
    asked = view(spark, sf_dir, "v_requests").select("job_id", F.floor(F.col("job_id") / 64).alias("video_id"))
    results = view(spark, sf_dir, "v_videos").select("video_id", F.when(F.col("video_id") % 4 != 0, F.col("fps")).alias("fps"))
    return jobs.completed_jobs(asked, results).withColumnRenamed("video_id", "video")


@query("select job_id, case when job_id % 3 = 0 then 'own' else 'default' end as topic from v_requests")
def resolve_topic(spark, sf_dir):
    rows = view(spark, sf_dir, "v_requests").withColumn("sns_topic_arn", F.when(F.col("job_id") % 3 == 0, "own").when(F.col("job_id") % 3 == 1, ""))
    return jobs.resolve_topic(rows, "default").select("job_id", "topic")


@query(
    f"""select w.video_id, w.window_no, 'Frames in this window: ' || cast(w.n as varchar) || '. Frame numbers: [' || w.frames || ']. Context so far: ' || coalesce(nullif(c.context, ''), 'Start of the match.') || '. Answer with JSON: current_context_summary and clips.' as prompt
 from win w left join ctx c on c.video_id = w.video_id and c.window_no = w.window_no""",
    body=BODY,
    parsed=PARSED,
    keyed=KEYED,
    ctx=CONTEXT,
    win=WINDOWS,
)
def build_prompts(spark, sf_dir):
    context = carry_context(spark, sf_dir)
    rows = windows.sliding_windows(view(spark, sf_dir, "v_frames")).withColumn("window_no", F.col("window_no").cast("long"))
    return windows.build_prompts(rows.join(context, ["video_id", "window_no"], "left")).select("video_id", "window_no", "prompt")


@query(
    "select w.video_id, w.window_no, 'Report on ' || cast(w.n as varchar) || ' frames [' || w.frames || '] in your role. Context so far: ' || coalesce(c.context, 'None') as prompt from win w left join ctx c on c.video_id = w.video_id and c.window_no = w.window_no",
    body=BODY,
    parsed=PARSED,
    keyed=KEYED,
    ctx=CONTEXT,
    win=WINDOWS,
)
def build_prompts_multi(spark, sf_dir):
    context = carry_context(spark, sf_dir)
    rows = windows.sliding_windows(view(spark, sf_dir, "v_frames")).withColumn("window_no", F.col("window_no").cast("long"))
    return windows.build_prompts(rows.join(context, ["video_id", "window_no"], "left"), "multi").select("video_id", "window_no", "prompt")


@query("select job_id, 's3://' || output_s3_bucket || '/' || output_s3_key as uri from v_requests")
def result_uris(spark, sf_dir):
    return view(spark, sf_dir, "v_requests").select("job_id", result_uri("output_s3_bucket", "output_s3_key").alias("uri"))


@query("select job_id, seq, coalesce(progress, case status when 'downloading' then 0.05 when 'processing' then 0.1 when 'uploading' then 0.85 when 'publishing' then 0.95 when 'completed' then 1.0 end) as progress from v_updates")
def milestone_progress(spark, sf_dir):
    return jobs.milestone_progress(view(spark, sf_dir, "v_updates")).select("job_id", "seq", "progress")


@query("select vec_id, round(f[1] / sqrt(list_dot_product(f, f)), 6) as first, round(list_sum(f) / sqrt(list_dot_product(f, f)), 6) as total from look", look=LOOK)
def l2_normalized(spark, sf_dir):
    unit = looks(spark, sf_dir).select("vec_id", l2_normalize("features").alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
