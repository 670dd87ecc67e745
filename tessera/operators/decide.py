"""Decisions about segments: routing, fallback, quality gate, retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed thresholds of the router.
ROUTER = {"empty_mask": 1e-7, "large_mask": 0.18, "short_frames": 5, "sufficient_coverage": 0.90, "sufficient_confidence": 0.76, "low_flicker": 0.38, "small_residual": 0.012, "partial_coverage": 0.55, "partial_residual": 0.08, "small_diameter": 24.0, "hard_flow": 0.52, "hard_crossing": 0.35, "hard_mask": 0.06, "vram_reserve_mb": 700}
#: Back ends in order of preference for each route.
CHAINS = {"tbe_telea": ["telea", "navier_stokes"], "tbe_lama": ["lama", "telea", "navier_stokes"], "tbe_migan": ["migan", "lama", "telea"], "official_propainter": ["propainter", "lama", "sttn", "telea"], "sttn_fallback": ["sttn", "lama", "telea"]}
#: The retry ladder.
LADDER = ["expand_mask", "upgrade_flow_and_references", "residual_lama", "official_propainter", "manual_review"]
#: Limits of the quality gate.
GATE = {"residual_text_probability": 0.24, "residual_drop": 0.55, "temporal_flicker_ratio": 2.4, "temporal_flicker_p95": 0.085, "boundary_color_delta_proxy": 5.5, "boundary_gradient_ratio": 2.2, "outside_mask_max_error": 1.0, "sharpness_ratio": 0.42}
ROUTES = ["copy", "tbe_only", "tbe_telea", "tbe_lama", "tbe_migan", "official_propainter", "sttn_fallback", "review"]


def route(segments: DataFrame, free_vram_mb: Column | None = None, predicted_vram_mb: Column | None = None) -> DataFrame:
    """``segments`` with route and reasons (array); one decision tree, evaluated in order.

    Without ``free_vram_mb`` (or where it is null) the memory of the temporal model is not known.
    """
    t, c = ROUTER, F.col
    free = F.lit(None).cast("double") if free_vram_mb is None else free_vram_mb
    need = F.lit(None).cast("double") if predicted_vram_mb is None else predicted_vram_mb
    mask, coverage = c("mask_ratio_of_frame"), c("mean_clean_plate_coverage")
    diameter = F.sqrt(F.greatest(c("largest_residual_component_px"), F.lit(0)) * 4 / math.pi)
    sufficient = (coverage >= t["sufficient_coverage"]) & (c("mean_clean_plate_confidence") >= t["sufficient_confidence"]) & (c("flicker_risk") <= t["low_flicker"]) & (c("residual_mask_ratio_of_roi") <= t["small_residual"])
    partial = (coverage >= t["partial_coverage"]) & (c("residual_mask_ratio_of_roi") <= t["partial_residual"])
    hard = (coverage < t["partial_coverage"]) | (c("mean_flow_confidence") < t["hard_flow"]) | (c("foreground_crossing_score") > t["hard_crossing"]) | (mask > t["hard_mask"])
    fits = need.isNull() | (need + t["vram_reserve_mb"] <= free)
    large = F.when(mask > t["large_mask"], "very_large_mask")
    case = lambda name, *why: F.struct(F.lit(name).alias("route"), F.array_compact(F.array(*[F.lit(w) if isinstance(w, str) else w for w in why])).alias("reasons"))
    chosen = (
        F.when(mask <= t["empty_mask"], case("copy", "mask_empty"))
        .when(c("frame_count") < t["short_frames"], case("review", "shot_too_short_for_temporal_recovery"))
        .when(sufficient, case("tbe_only", "clean_plate_sufficient"))
        .when(partial & (diameter <= t["small_diameter"]), case("tbe_telea", "small_residual_components"))
        .when(partial, case("tbe_lama", "bounded_residual_after_clean_plate"))
        .when(hard & free.isNull(), case("official_propainter", large, "hard_temporal_segment", "gpu_memory_unknown"))
        .when(hard & fits, case("official_propainter", large, "hard_temporal_segment", "vram_budget_passed"))
        .when(hard, case("sttn_fallback", large, "hard_temporal_segment", "vram_budget_exceeded"))
        .otherwise(case("tbe_lama", large, "intermediate_residual"))
    )
    return segments.withColumn("decision", chosen).select("*", "decision.route", "decision.reasons").drop("decision")


def force_route(asked: Column, decided: Column) -> Column:
    """The asked route where it names one, else the decided."""
    return F.when(F.lower(asked).isin(ROUTES), F.lower(asked)).otherwise(decided)


def chain_of(route_: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, chain in CHAINS.items():
        out = F.when(route_ == name, F.array(*[F.lit(x) for x in chain])).otherwise(out)
    return out


def engine(decided: DataFrame, available: DataFrame, route_col: str = "route") -> DataFrame:
    """With engine: the first of the route's chain that ``available`` (column engine) has; null if none or no chain."""
    ready = available.agg(F.collect_set("engine").alias("ready"))  # a handful of back ends
    joined = decided.crossJoin(F.broadcast(ready))
    return joined.withColumn("engine", F.try_element_at(F.filter(chain_of(F.col(route_col)), lambda e: F.array_contains("ready", e)), F.lit(1))).drop("ready")


def best_effort(route_: Column, residual: Column) -> Column:
    """What runs: a reviewed segment still gets the temporal model if its residual is large, else the spatial one."""
    return F.when(route_ != "review", route_).when(residual > 0.08, "official_propainter").otherwise("tbe_lama")


def drop_of(before: Column, after: Column) -> Column:
    return F.when(before == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (before - after) / F.greatest(before, F.lit(1e-6)))))


def gate_rows(measured: DataFrame, key: list[str]) -> DataFrame:
    """A row for each metric: key, metric, value, threshold, passed.

    ``measured`` has residual_before and residual_after (null after: the detector failed, which passes), flicker_ratio,
    flicker_p95, color_delta, gradient_ratio, outside_error, sharpness. Flicker and seam pass if either of their limits is met.
    """
    c, g = F.col, GATE
    residual = F.coalesce((c("residual_after") <= g["residual_text_probability"]) | (drop_of(c("residual_before"), c("residual_after")) >= g["residual_drop"]), F.lit(True))
    flicker = (c("flicker_ratio") <= g["temporal_flicker_ratio"]) | (c("flicker_p95") <= g["temporal_flicker_p95"])
    seam = (c("color_delta") <= g["boundary_color_delta_proxy"]) | (c("gradient_ratio") <= g["boundary_gradient_ratio"])
    rows = [
        ("residual_text_probability", c("residual_after"), residual), ("temporal_flicker_ratio", c("flicker_ratio"), flicker), ("temporal_flicker_p95", c("flicker_p95"), flicker),
        ("boundary_color_delta_proxy", c("color_delta"), seam), ("boundary_gradient_ratio", c("gradient_ratio"), seam),
        ("outside_mask_max_error", c("outside_error"), c("outside_error") <= g["outside_mask_max_error"]), ("sharpness_ratio", c("sharpness"), c("sharpness") >= g["sharpness_ratio"]),
    ]
    packed = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"), F.lit(float(g[n])).alias("threshold"), ok.alias("passed")) for n, v, ok in rows])
    return measured.select(*key, F.explode(packed).alias("m")).select(*key, "m.*")


def gate(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, passed, action (null if passed), penalty: the sum over failed metrics of 1 and their capped relative excess."""
    failed = lambda start: F.bool_or(~F.col("passed") & F.col("metric").startswith(start))
    action = F.when(failed("outside_mask"), "manual_review").when(failed("residual") | failed("boundary"), "expand_mask").when(failed("temporal_flicker"), "upgrade_flow_and_references").when(failed("sharpness"), "residual_lama")
    excess = F.abs(F.col("value") - F.col("threshold")) / F.greatest(F.abs("threshold"), F.lit(0.001))
    penalty = F.coalesce(F.sum(F.when(~F.col("passed"), 1 + F.least(F.lit(10.0), F.coalesce(excess, F.lit(0.0))))), F.lit(0.0))
    return rows.groupBy(*key).agg(F.bool_and("passed").alias("passed"), action.alias("action"), penalty.alias("penalty"))


def next_attempt(suggested: Column, attempt: Column, passed: Column) -> Column:
    """The struct (action, mask_expand_px, force_route) of the next attempt; null if it stops here."""
    at = F.array_position(F.array(*[F.lit(x) for x in LADDER]), suggested)
    start = F.when(at > 0, at.cast("int") - 1).otherwise(F.least(attempt, F.lit(4)))
    action = F.element_at(F.array(*[F.lit(x) for x in LADDER]), F.least(F.greatest(start, attempt), F.lit(4)).cast("int") + 1)
    px = F.when(action == "expand_mask", 3 * (attempt + 1)).when(action == "upgrade_flow_and_references", 3).otherwise(0)
    forced = F.when(action == "residual_lama", "tbe_lama").when(action == "official_propainter", "official_propainter")
    out = F.struct(action.alias("action"), px.cast("bigint").alias("mask_expand_px"), forced.alias("force_route"))
    return F.when(~passed & (attempt < 4) & (action != "manual_review"), out)


def best_attempt(attempts: DataFrame, key: list[str]) -> DataFrame:
    """The attempt of least penalty, the earliest of equal ones: key, attempt, penalty, passed."""
    return attempts.groupBy(*key).agg(F.min_by(F.struct("attempt", "penalty", "passed"), F.struct("penalty", "attempt")).alias("b")).select(*key, "b.*")


def needs_review(passed: Column, reason: Column, uncertain: Column, protected: Column) -> Column:
    no = F.lit(False)
    return ~F.coalesce(passed, no) | (F.coalesce(reason, F.lit("")) != "") | F.coalesce(uncertain, no) | F.coalesce(protected, no)


def job_summary(segments: DataFrame) -> DataFrame:
    """Per job: segments, conditional counts and their rates."""
    n = F.greatest(F.count("*"), F.lit(1))
    heavy, review, clean = F.col("route").isin("official_propainter", "sttn_fallback"), F.col("route") == "review", F.col("route").isin("copy", "tbe_only")
    return segments.groupBy("job_id").agg(
        F.count("*").alias("segments"), F.sum("frame_count").alias("frames"), F.count_if(heavy).alias("heavy"), F.count_if(review).alias("review"), F.count_if(clean).alias("clean"),
        F.round(F.count_if(heavy) / n, 6).alias("heavy_rate"), F.round(F.count_if(review) / n, 6).alias("review_rate"),
        F.round(F.sum(F.when(heavy, F.col("frame_count")).otherwise(0)) / F.greatest(F.sum("frame_count"), F.lit(1)), 6).alias("heavy_frame_rate"),
    )


def retry_loop(first: DataFrame, key: list[str], evaluate, rounds: int = 5) -> DataFrame:
    """Attempts of every segment until it passes or the ladder ends; ``evaluate`` maps (segments, attempt) to key, passed, action, penalty.

    Only failing segments are carried into the next of at most five passes; the carried state (largest expansion, sticky forced
    route) travels with them. Returns all attempts.
    """
    now, out = first.select("*", F.lit(0).cast("bigint").alias("mask_expand_px"), F.lit(None).cast("string").alias("force_route")), None
    for attempt in range(rounds):
        judged = evaluate(now, attempt).select(*key, "passed", "action", "penalty", F.lit(attempt).cast("bigint").alias("attempt"))
        out = judged if out is None else out.unionByName(judged)
        step = next_attempt(F.col("action"), F.col("attempt"), F.col("passed"))
        carried = judged.select(*key, step.alias("step")).where(F.col("step").isNotNull())
        now = now.join(carried, key).withColumn("mask_expand_px", F.greatest("mask_expand_px", "step.mask_expand_px")).withColumn("force_route", F.coalesce("step.force_route", "force_route")).drop("step")
    return out
