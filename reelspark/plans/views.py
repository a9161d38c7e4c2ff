"""Adapter views: inputs of the operators derived from the driver's tables, in SQL that both engines accept.

Videos are eight customers' orders, or one user's events, so that their number grows with the tables and their size does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: In an order in which each needs only tables and earlier views.
VIEWS = {
    "v_videos": r"""
select v.video_id, cast(m.mx + 1 - floor(m.mx / 20) * (v.video_id % 5) as bigint) as total_frames, 1920 as width, 1080 as height,
 case v.video_id % 5 when 0 then cast(30.0 as double) when 1 then cast(25.0 as double) when 2 then cast(29.97 as double) when 3 then cast(0.5 as double) else cast(0.0 as double) end as fps
from (select distinct cast(floor(o_custkey / 8) as bigint) as video_id from orders) v cross join (select max(o_orderkey) as mx from orders) m""",
    "v_frames": r"""
select cast(floor(o_custkey / 8) as bigint) as video_id, o_orderkey as frame from orders""",
    "v_athletes": r"""
select f.video_id, f.frame, cast(row_number() over (partition by f.video_id, f.frame order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as bigint) as det_idx,
 cast((l_partkey * 7) % 1800 as double) as x1, cast((l_suppkey * 11) % 1000 as double) as y1,
 (l_partkey * 7) % 1800 + l_quantity * 8 as x2, cast((l_suppkey * 11) % 1000 + 20 + l_linenumber * 30 as double) as y2
from v_frames f join lineitem on l_orderkey = f.frame""",
    "v_clips": r"""
select user_id as video_id, event_id as pos,
 cast((day(ts) - 1) * 144 + hour(ts) * 6 + floor(minute(ts) / 10) as bigint) as start_frame,
 cast((day(ts) - 1) * 144 + hour(ts) * 6 + floor(minute(ts) / 10) + floor(value / 10) as bigint) as end_frame,
 case event_type when 'click' then 'STANDUP_GAME' when 'view' then 'GUARD_PLAY' when 'purchase' then 'SUBMISSION_OFFENSE' when 'signup' then 'GUARD_PASSING' else 'DEFENSE_ESCAPES' end as category,
 props as specific_technique, event_type as role, case when event_id % 13 = 0 then null else value / 500 end as confidence from events""",
    "v_responses": r"""
select user_id as video_id, cast(row_number() over (partition by user_id order by event_id) as bigint) as window_no,
 case event_id % 8 when 0 then 'note ```json' || j || '``` end' when 1 then '```' || j || '```' when 2 then j || ' junk' when 3 then '{"error":"x"}' when 4 then 'not json' else j end as response
from (select *, '{"current_context_summary":' || case when event_id % 5 = 0 then 'null' else '"s' || cast(event_id as string) || '"' end || ',"clips":[{"start_frame":' || cast(event_id % 5000 as string) || ',"end_frame":' || cast(event_id % 5000 + 20 as string) || ',"category":"' || event_type || '","confidence":0.' || lpad(cast(event_id % 100 as string), 2, '0') || '}]}' as j from events) t""",
    "v_messages": r"""
with e as (select *, cast(row_number() over (partition by user_id order by event_id) as bigint) as ix, count(*) over (partition by user_id) as n from events)
select user_id as video_id, 'bjj_event_detected' as event_type, ix as event_index, n as total_events, md5(cast(user_id as string) || '|' || cast(ix as string)) as id, event_type as category, ts from e where not (user_id % 7 = 0 and ix = 1)
union all select user_id, 'bjj_event_detected', ix, n, md5(cast(user_id as string) || '|' || cast(ix as string)), event_type, ts from e where event_id % 10 = 0 and not (user_id % 7 = 0 and ix = 1)
union all select distinct user_id, 'analysis_complete', cast(null as bigint), n, 'done-' || cast(user_id as string), cast(null as string), cast(null as timestamp) from e where user_id % 11 <> 0
union all select c_custkey + 1000000, 'analysis_complete', cast(null as bigint), 0, 'done-' || cast(c_custkey + 1000000 as string), cast(null as string), cast(null as timestamp) from customer""",
    "v_updates": r"""
select user_id as job_id, event_id as seq, case event_type when 'click' then 'downloading' when 'view' then 'processing' when 'purchase' then 'completed' when 'signup' then 'uploading' else 'failed' end as status,
 case when event_id % 3 = 0 then null else value / 500 end as progress, case when event_id % 4 = 0 then null else props end as message, case when event_type = 'error' then props end as error, ts as updated_at from events""",
    "v_requests": r"""
select o_orderkey as job_id, case when o_orderkey % 17 = 0 then 'bad-id' else '00000000-0000-0000-0000-' || lpad(cast(o_custkey as string), 12, '0') end as video_id,
 cast(case when o_orderkey % 6 = 5 then null else o_orderkey % 6 end as string) as sampling_rate, case o_orderkey % 5 when 0 then 'single' when 1 then 'multi' when 2 then 'both' end as analyzer_mode,
 case o_orderkey % 4 when 0 then 'swinir' when 1 then 'hat' when 2 then 'diffusion' end as method,
 case when o_orderkey % 19 <> 0 then 'in' end as video_s3_bucket, 'v' || cast(o_orderkey as string) as video_s3_key, 'in' as tracking_json_s3_bucket, case when o_orderkey % 23 <> 0 then 't' end as tracking_json_s3_key,
 'out' as output_s3_bucket, 'r/' || cast(o_orderkey as string) as output_s3_key from orders""",
    "v_request_texts": r"""
select o_orderkey as job_id, '{"video_id":' || case o_orderkey % 17 when 0 then '"bad-id"' when 1 then '5' when 2 then 'null' when 3 then '"{00000000-0000-0000-0000-00000000000A}"' else '"00000000-0000-0000-0000-' || lpad(cast(o_custkey as string), 12, '0') || '"' end
 || case o_orderkey % 19 when 0 then '' when 1 then ',"video_s3_bucket":7' when 2 then ',"video_s3_bucket":null' else ',"video_s3_bucket":"in"' end || ',"video_s3_key":"v","tracking_json_s3_bucket":"in","tracking_json_s3_key":"t","output_s3_bucket":"out","output_s3_key":"r"'
 || case o_orderkey % 8 when 0 then '' when 1 then ',"sampling_rate":null' when 2 then ',"sampling_rate":2.0' when 3 then ',"sampling_rate":"3"' when 4 then ',"sampling_rate":2.5' when 5 then ',"sampling_rate":0' when 6 then ',"sampling_rate":"x"' else ',"sampling_rate":4' end
 || case o_orderkey % 5 when 0 then '' when 1 then ',"analyzer_mode":null' when 2 then ',"analyzer_mode":"multi"' when 3 then ',"analyzer_mode":1' else ',"analyzer_mode":"both"' end
 || case o_orderkey % 6 when 0 then '' when 1 then ',"method":null' when 2 then ',"method":3' else ',"method":"hat"' end || case o_orderkey % 7 when 0 then ',"sns_topic_arn":null' when 1 then ',"sns_topic_arn":[]' when 2 then ',"sns_topic_arn":"arn"' else '' end || ',"job":' || cast(o_orderkey as string) || ',"more":{"a":1}}' as request from orders""",
}
TABLES = ("orders", "lineitem", "events", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view `name` over the tables in `sf_dir`."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n, sql in VIEWS.items():
        if n == name:
            return spark.sql(sql)
        if n == "v_frames":
            spark.sql(sql).createOrReplaceTempView(n)
    raise KeyError(name)


def with_views(select: str, **more: str) -> str:
    """`select` as one statement that names the views (and `more` parts) it uses."""
    parts, text = [], select + " ".join(more.values())
    for n in reversed(VIEWS):
        if n in text:
            parts.append((n, VIEWS[n]))
            text += VIEWS[n]
    parts = parts[::-1] + [(n, q) for n, q in more.items()]
    return "with recursive " + ",\n".join(f"{n} as ({q})" for n, q in parts) + "\n" + select if parts else select
