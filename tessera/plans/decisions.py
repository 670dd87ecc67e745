"""Queries over segments: routing, summaries, fallback, quality gate, retry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import media
from tessera.operators import decide
from tessera.plans.registry import query
from tessera.plans.views import duck, view

ROUTE_SQL = """case when mask_ratio_of_frame <= 1e-7 then 'copy' when frame_count < 5 then 'review'
  when mean_clean_plate_coverage >= 0.90 and mean_clean_plate_confidence >= 0.76 and flicker_risk <= 0.38 and residual_mask_ratio_of_roi <= 0.012 then 'tbe_only'
  when mean_clean_plate_coverage >= 0.55 and residual_mask_ratio_of_roi <= 0.08 then case when sqrt(greatest(largest_residual_component_px, 0) * 4 / pi()) <= 24 then 'tbe_telea' else 'tbe_lama' end
  when mean_clean_plate_coverage < 0.55 or mean_flow_confidence < 0.52 or foreground_crossing_score > 0.35 or mask_ratio_of_frame > 0.06 then 'official_propainter'
  else 'tbe_lama' end"""
ROUTED = duck("v_segments") + f",\nr as (select *, {ROUTE_SQL} as route from v_segments)\n"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.route(view(spark, sf_dir, "v_segments"))


@query(ROUTED + "select job_id, route, cast(count(*) as bigint) n, cast(sum(frame_count) as bigint) frames from r group by job_id, route")
def h01_route_histogram(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("job_id", "route").agg(F.count("*").alias("n"), F.sum("frame_count").alias("frames"))


@query(ROUTED + """select segment_id, route, concat_ws('+', case when mask_ratio_of_frame > 0.18 and route in ('official_propainter') then 'very_large_mask' end,
  case route when 'copy' then 'mask_empty' when 'review' then 'shot_too_short_for_temporal_recovery' when 'tbe_only' then 'clean_plate_sufficient' when 'tbe_telea' then 'small_residual_components'
    when 'official_propainter' then 'hard_temporal_segment+gpu_memory_unknown' else case when mean_clean_plate_coverage >= 0.55 and residual_mask_ratio_of_roi <= 0.08 then 'bounded_residual_after_clean_plate' else 'intermediate_residual' end end) reasons from r""")
def h01_route_reasons(spark, sf_dir):
    return routed(spark, sf_dir).select("segment_id", "route", F.array_join("reasons", "+").alias("reasons"))


_BUDGET = """, b as (select *, cast(round_even((900 + 0.00027 * px * frame_count + 0.0025 * px + 4e-9 * px * px) * case when segment_id % 2 = 0 then 1 else 1.45 end, 0) as bigint) need
  from (select *, cast(largest_residual_component_px * 40 as bigint) px from r))"""


@query(ROUTED + _BUDGET + " select segment_id, px, need, case when route <> 'official_propainter' then route when need + 700 <= 1800 then route else 'sttn_fallback' end route from b")
def h01_route_with_memory(spark, sf_dir):
    sized = view(spark, sf_dir, "v_segments").withColumn("px", F.col("largest_residual_component_px") * 40)
    sized = sized.withColumn("need", media.vram_mb(F.col("px"), F.col("frame_count"), F.col("segment_id") % 2 == 0))
    return decide.route(sized, F.lit(1800), F.col("need")).select("segment_id", "px", "need", "route")


@query(ROUTED + """select job_id, cast(count(*) as bigint) segments, cast(sum(frame_count) as bigint) frames, cast(count(*) filter (route in ('official_propainter', 'sttn_fallback')) as bigint) heavy,
  cast(count(*) filter (route = 'review') as bigint) review, cast(count(*) filter (route in ('copy', 'tbe_only')) as bigint) clean,
  round(count(*) filter (route in ('official_propainter', 'sttn_fallback')) / count(*), 6) heavy_rate, round(count(*) filter (route = 'review') / count(*), 6) review_rate,
  round(sum(case when route in ('official_propainter', 'sttn_fallback') then frame_count else 0 end) / greatest(sum(frame_count), 1), 6) heavy_frame_rate from r group by job_id""")
def d25_job_summary(spark, sf_dir):
    return decide.job_summary(routed(spark, sf_dir))


@query(ROUTED + "select job_id, array_to_string(list(route || '=' || n order by route), ',') histogram from (select job_id, route, count(*) n from r group by 1, 2) group by job_id")
def d26_histogram(spark, sf_dir):
    counted = routed(spark, sf_dir).groupBy("job_id", "route").count()
    packed = counted.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "count")))).alias("m"))
    return packed.select("job_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"))


@query(ROUTED + """select segment_id, route, case route when 'tbe_telea' then 'telea' when 'tbe_lama' then 'telea' when 'official_propainter' then 'sttn' end engine from r""")
def h05_engine_fallback(spark, sf_dir):
    ready = spark.createDataFrame([("telea",), ("sttn",)], "engine string")
    return decide.engine(routed(spark, sf_dir), ready).select("segment_id", "route", "engine")


@query(ROUTED + "select segment_id, case when segment_id % 5 = 0 then 'tbe_migan' else route end route, case when route <> 'review' then route when residual_mask_ratio_of_roi > 0.08 then 'official_propainter' else 'tbe_lama' end runs from r")
def h04_forced_route(spark, sf_dir):
    asked = F.when(F.col("segment_id") % 5 == 0, "TBE_MIGAN").when(F.col("segment_id") % 7 == 0, "nonsense")
    return routed(spark, sf_dir).select("segment_id", decide.force_route(asked, F.col("route")).alias("route"), decide.best_effort(F.col("route"), F.col("residual_mask_ratio_of_roi")).alias("runs"))


MEASURED = """m as (select segment_id, job_id, foreground_crossing_score residual_before, case when segment_id % 13 = 0 then null else residual_mask_ratio_of_roi * 5 end residual_after,
  flicker_risk * 6 flicker_ratio, mask_ratio_of_frame flicker_p95, mask_ratio_of_frame * 60 color_delta, 2 + foreground_crossing_score gradient_ratio,
  cast(frame_count % 3 as double) outside_error, mean_clean_plate_confidence sharpness from v_segments)"""
GATED = duck("v_segments") + ",\n" + MEASURED + """,
p as (select *, case when residual_before = 0 then 1.0 else greatest(0, least(1, (residual_before - residual_after) / greatest(residual_before, 1e-6))) end d from m),
k as (select *, coalesce(residual_after <= 0.24 or d >= 0.55, true) ok_r, (flicker_ratio <= 2.4 or flicker_p95 <= 0.085) ok_f, (color_delta <= 5.5 or gradient_ratio <= 2.2) ok_s, outside_error <= 1 ok_o, sharpness >= 0.42 ok_h from p),
rows_ as (select segment_id, unnest(['residual_text_probability', 'temporal_flicker_ratio', 'temporal_flicker_p95', 'boundary_color_delta_proxy', 'boundary_gradient_ratio', 'outside_mask_max_error', 'sharpness_ratio']) metric,
  unnest([residual_after, flicker_ratio, flicker_p95, color_delta, gradient_ratio, outside_error, sharpness]) "value", unnest([0.24::double, 2.4::double, 0.085::double, 5.5::double, 2.2::double, 1::double, 0.42::double]) threshold, unnest([ok_r, ok_f, ok_f, ok_s, ok_s, ok_o, ok_h]) passed from k)
"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return view(spark, sf_dir, "v_segments").select(
        "segment_id", "job_id", c("foreground_crossing_score").alias("residual_before"), F.when(c("segment_id") % 13 != 0, c("residual_mask_ratio_of_roi") * 5).alias("residual_after"), (c("flicker_risk") * 6).alias("flicker_ratio"),
        c("mask_ratio_of_frame").alias("flicker_p95"), (c("mask_ratio_of_frame") * 60).alias("color_delta"), (2 + c("foreground_crossing_score")).alias("gradient_ratio"), (c("frame_count") % 3).cast("double").alias("outside_error"), c("mean_clean_plate_confidence").alias("sharpness"),
    )


@query(GATED + 'select segment_id, metric, round("value", 6) "value", threshold, passed from rows_')
def d27_gate_metrics(spark, sf_dir):
    return decide.gate_rows(measured(spark, sf_dir), ["segment_id"]).withColumn("value", F.round("value", 6))


GATE_SQL = """select segment_id, bool_and(passed) passed,
  case when bool_or(not passed and starts_with(metric, 'outside_mask')) then 'manual_review' when bool_or(not passed and (starts_with(metric, 'residual') or starts_with(metric, 'boundary'))) then 'expand_mask'
    when bool_or(not passed and starts_with(metric, 'temporal_flicker')) then 'upgrade_flow_and_references' when bool_or(not passed and starts_with(metric, 'sharpness')) then 'residual_lama' end action,
  coalesce(sum(case when not passed then 1 + least(10, coalesce(abs("value" - threshold) / greatest(abs(threshold), 0.001), 0)) end), 0) penalty from rows_ group by segment_id"""


@query(GATED + f"select segment_id, passed, action from ({GATE_SQL})")
def d27_quality_gate(spark, sf_dir):
    return decide.gate(decide.gate_rows(measured(spark, sf_dir), ["segment_id"]), ["segment_id"]).drop("penalty")


@query(GATED + f"select segment_id, round(cast(penalty as double), 6) penalty from ({GATE_SQL})")
def d28_quality_penalty(spark, sf_dir):
    return decide.gate(decide.gate_rows(measured(spark, sf_dir), ["segment_id"]), ["segment_id"]).select("segment_id", F.round("penalty", 6).alias("penalty"))


@query(GATED + f""", g as (select *, segment_id % 6 attempt, case action when 'expand_mask' then 0 when 'upgrade_flow_and_references' then 1 when 'residual_lama' then 2 when 'manual_review' then 4 else least(segment_id % 6, 4) end st from ({GATE_SQL})),
h as (select *, least(greatest(st, attempt), 4) ix, not passed and attempt < 4 and least(greatest(st, attempt), 4) < 4 go from g)
select segment_id, cast(attempt as bigint) attempt, case when go then (['expand_mask', 'upgrade_flow_and_references', 'residual_lama', 'official_propainter'])[ix + 1] end action,
  case when go then cast(case ix when 0 then 3 * (attempt + 1) when 1 then 3 else 0 end as bigint) end mask_expand_px, case when go then case ix when 2 then 'tbe_lama' when 3 then 'official_propainter' end end force_route from h""")
def h02_retry_plan(spark, sf_dir):
    judged = decide.gate(decide.gate_rows(measured(spark, sf_dir), ["segment_id"]), ["segment_id"]).withColumn("attempt", F.col("segment_id") % 6)
    return judged.select("segment_id", "attempt", decide.next_attempt(F.col("action"), F.col("attempt"), F.col("passed")).alias("n")).select("segment_id", "attempt", "n.action", "n.mask_expand_px", "n.force_route")


_ATTEMPTS = """, a as (select l_orderkey segment_id, l_linenumber attempt, cast(min(floor(l_quantity / 10)) as bigint) penalty, bool_or(l_returnflag = 'A') passed from lineitem group by 1, 2),
b as (select *, row_number() over (partition by segment_id order by penalty, attempt) rn from a) select segment_id, attempt, penalty, passed from b where rn = 1"""


@query("with x as (select 1)" + _ATTEMPTS)
def h03_best_attempt(spark, sf_dir):
    c = F.col
    attempts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(c("l_orderkey").alias("segment_id"), c("l_linenumber").alias("attempt")).agg(F.min(F.floor(c("l_quantity") / 10)).alias("penalty"), F.bool_or(c("l_returnflag") == "A").alias("passed"))
    return decide.best_attempt(attempts, ["segment_id"])


@query(duck("v_segments") + """select segment_id, not (flicker_risk < 0.45) or segment_id % 17 = 0 or mean_flow_confidence < 0.62 review from v_segments""")
def h16_review_flag(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "v_segments").select("segment_id", decide.needs_review(c("flicker_risk") < 0.45, F.when(c("segment_id") % 17 == 0, "asked"), c("mean_flow_confidence") < 0.62, F.lit(None).cast("boolean")).alias("review"))


@query(duck("v_segments") + """select job_id, round(avg(mean_clean_plate_coverage) filter (mask_ratio_of_frame > 0), 6) coverage, round(avg(mean_clean_plate_confidence) filter (mask_ratio_of_frame > 0), 6) confidence,
  round(sum(residual_mask_ratio_of_roi) filter (mask_ratio_of_frame > 0) / greatest(sum(mask_ratio_of_frame) filter (mask_ratio_of_frame > 0), 1), 6) residual_ratio, max(largest_residual_component_px) filter (mask_ratio_of_frame > 0) largest from v_segments group by job_id""")
def d04_clean_plate_rollup(spark, sf_dir):
    from tessera.operators.aggregate import clean_plate_rollup

    c = F.col
    s = view(spark, sf_dir, "v_segments").select("job_id", (c("mask_ratio_of_frame") > 0).alias("has_mask"), c("mean_clean_plate_coverage").alias("coverage"), c("mean_clean_plate_confidence").alias("confidence"), c("residual_mask_ratio_of_roi").alias("residual_px"), c("mask_ratio_of_frame").alias("mask_px"), c("largest_residual_component_px").alias("component_px"))
    out = clean_plate_rollup(s, ["job_id"])
    return out.select("job_id", *[F.round(x, 6).alias(x) for x in ("coverage", "confidence", "residual_ratio")], "largest")
