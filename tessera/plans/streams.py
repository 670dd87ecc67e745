"""Streaming queries (J01-J06), each run to the end of a bounded stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.boxes import tracked_shots
from tessera.plans.registry import query
from tessera.streaming import events as stream


@query("select user_id, epoch_us(time_bucket(interval 6 hours, ts, timestamp '1970-01-01')) start_us, count(*) n, cast(sum(cast(value as decimal(18,4))) as double) total from events group by 1, 2")
def j01_tumbling_counts(spark, sf_dir):
    return stream.drain(spark, sf_dir, lambda e: stream.tumbling(e, "6 hours", "1 hour"))


@query("""
with w as (select event_type, value, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') b from events)
select event_type, epoch_us(b - k * interval 6 hours) start_us, count(*) n, max(value) top from w, (values (0), (1)) t(k) group by 1, 2""")
def j02_sliding_context(spark, sf_dir):
    return stream.drain(spark, sf_dir, lambda e: stream.sliding(e, "12 hours", "6 hours", "1 hour"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 10 hours then 0 else 1 end new, event_id from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) s from g)
select user_id, epoch_us(min(ts)) start_us, epoch_us(max(ts)) last_us, count(*) n from s group by user_id, s""")
def j03_sessions(spark, sf_dir):
    return stream.drain(spark, sf_dir, lambda e: stream.sessions(e, "10 hours", "1 hour"))


@query()
def j04_online_tracks(spark, sf_dir):
    """The tracker of e12 over a stream of detections; a frame is a second, the first one after the epoch, as a watermark starts there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    ts = F.timestamp_seconds(F.expr("cast(floor(o_orderkey / 10) as bigint) % 120 + 1"))
    return stream.drain(spark, sf_dir, lambda d: stream.online_tracks(tracked_shots(d, "ts"), "10 seconds", ["job_id", "shot_id"]), "orders", ts)


@query("select user_id, max_by(event_type, event_id) state, max(event_id) since from events group by 1")
def j05_current_state(spark, sf_dir):
    return stream.latest(spark, sf_dir, stream.current_state, ["user_id"])


@query("select min(event_id) event_id, user_id, event_type from events group by 2, 3")
def j06_first_only(spark, sf_dir):
    keys = ["user_id", "event_type"]
    return stream.latest(spark, sf_dir, lambda e: stream.first_only(e, keys), keys).select("event_id", *keys)
