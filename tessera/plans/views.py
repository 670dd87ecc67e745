"""Fixture views: the given tables reshaped into frames, detections, pixels, segments and job events.

They stand in for media, which the tables don't hold; the operators are the same for either. Each view has a
Spark form and a DuckDB form with equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FRAMES = """
select user_id as job_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_index,
  {us} - min({us}) over (partition by user_id) as pts_us,
  event_id as source_pts, event_type, value
from events"""
_DETECTIONS = """
select o_orderkey as det_id, cast(floor(o_orderkey / 1200) as bigint) as job_id,
  cast(floor(o_orderkey / 10) as bigint) % 120 as frame_index,
  (o_custkey % 4) * 400 + (o_custkey % 7) * 6 as x1,
  800 + (o_custkey % 5) * 5 as y1,
  (o_custkey % 4) * 400 + (o_custkey % 7) * 6 + 240 + (o_orderkey % 3) * 10 as x2,
  800 + (o_custkey % 5) * 5 + 48 + (o_orderkey % 4) * 2 as y2,
  cast(30 + cast(floor(o_totalprice) as bigint) % 70 as double) / 100 as confidence
from orders"""
_PIXELS = """
select vec_id as frame_index, cast(floor(vec_id / 25) as bigint) as shot_id, label,
  cast(floor(pos / 8) as bigint) as y, cast(pos % 8 as bigint) as x,
  least(255, greatest(0, cast(floor((cast(v as double) + 0.6) * 200) as bigint))) as value,
  case when floor(pos / 8) >= 5 and (vec_id + pos) % 3 <> 0 then 1 else 0 end as masked
from {cells}"""
_SEGMENTS = """
select l_orderkey as segment_id, l_orderkey % 10 as job_id,
  count(*) * 4 as frame_count,
  max(l_tax) * 1.5 as mask_ratio_of_frame,
  1 - max(l_discount) * 5 as mean_clean_plate_coverage,
  1 - max(l_discount) * 3 as mean_clean_plate_confidence,
  0.9 - max(l_discount) * 3 as mean_flow_confidence,
  min(l_tax) * 5 as foreground_crossing_score,
  max(l_quantity) / 100 as flicker_risk,
  cast(floor(max(l_extendedprice) / 20) as bigint) as largest_residual_component_px,
  min(l_discount) as residual_mask_ratio_of_roi
from lineitem group by l_orderkey"""
_EVENTS = """
select event_id, user_id as job_id, ts,
  case event_type when 'view' then 'analyzed' when 'click' then 'masked'
    when 'signup' then 'quality_check' when 'error' then 'retry_pending' else 'done' end as to_state,
  cast({json} as bigint) as payload_k
from events"""
_SPARK = {"us": "unix_micros(cast(ts as timestamp))", "json": "get_json_object(props, '$.k')", "cells": "embeddings lateral view posexplode(embedding) e as pos, v"}
_DUCK = {"us": "epoch_us(ts)", "json": "json_extract_string(props, '$.k')", "cells": "(select vec_id, label, unnest(range(64)) as pos, unnest(embedding) as v from embeddings)"}
VIEWS = {"v_frames": (_FRAMES, "events"), "v_detections": (_DETECTIONS, "orders"), "v_pixels": (_PIXELS, "embeddings"), "v_segments": (_SEGMENTS, "lineitem"), "v_job_events": (_EVENTS, "events")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    body, table = VIEWS[name]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    text = body.format(**_SPARK)
    return spark.sql(text.replace(f"from {table}", "from {source}"), source=source)


def detections_of(orders: DataFrame, *more: str) -> DataFrame:
    """The detections of a batch or stream of orders, with ``more`` of its columns."""
    head = "".join(f"{c}, " for c in more)
    return orders.sparkSession.sql(VIEWS["v_detections"][0].replace("select ", f"select {head}", 1).replace("from orders", "from {source}"), source=orders)


def duck(*names: str) -> str:
    """``with`` and the named views, for an oracle."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][0].format(**_DUCK)})" for n in names)
