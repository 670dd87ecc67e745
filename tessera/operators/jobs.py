"""Job control as an append-only event log and latest-wins views."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states that may follow each state of a job.
TRANSITIONS = {
    "discovered": ["probed", "cancelled", "failed"],
    "probed": ["analyzed", "encoding", "cancelled", "failed"],
    "analyzed": ["masked", "cancelled", "failed"],
    "masked": ["reconstructing", "cancelled", "failed"],
    "reconstructing": ["inpainting", "quality_check", "cancelled", "failed"],
    "inpainting": ["quality_check", "retry_pending", "cancelled", "failed"],
    "quality_check": ["reconstructing", "inpainting", "retry_pending", "encoding", "review_required", "cancelled", "failed"],
    "retry_pending": ["reconstructing", "inpainting", "review_required", "failed", "cancelled"],
    "encoding": ["done", "review_required", "failed", "cancelled"],
    "review_required": ["encoding", "done", "cancelled", "failed"],
    "done": [],
    "failed": ["retry_pending", "cancelled"],
    "cancelled": ["retry_pending"],
}


def current_state(events: DataFrame, key: str = "job_id") -> DataFrame:
    """key, state, since (event id), changes: the last event's state."""
    return events.groupBy(key).agg(F.max_by("to_state", "event_id").alias("state"), F.max("event_id").alias("since"), F.count("*").alias("changes"), F.count_if(F.col("to_state") == "retry_pending").alias("retries"))


def transitions(events: DataFrame, key: str = "job_id", first: str = "discovered") -> DataFrame:
    """Each event with the state before and whether the change is allowed; staying in a state is."""
    spark = events.sparkSession
    known = spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in [a, *bs]], "from_state string, to_state string").withColumn("allowed", F.lit(True))
    before = F.coalesce(F.lag("to_state").over(Window.partitionBy(key).orderBy("event_id")), F.lit(first))
    return events.withColumn("from_state", before).join(F.broadcast(known), ["from_state", "to_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def illegal(events: DataFrame, key: str = "job_id") -> DataFrame:
    return transitions(events, key).where(~F.col("allowed"))


def not_cancelled(jobs: DataFrame, events: DataFrame, key: str = "job_id", state: str = "cancel_requested") -> DataFrame:
    """Jobs that were never asked to stop; a request holds for every later run of the same job."""
    return jobs.join(events.where(F.col("to_state") == state).select(key), key, "left_anti")


def cancelled(jobs: DataFrame, events: DataFrame, key: str = "job_id", state: str = "cancel_requested") -> DataFrame:
    return jobs.join(events.where(F.col("to_state") == state).select(key), key, "left_semi")


def latest(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """One row for each key: the one of the largest version (insert or replace)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r")).select(*key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] | None = None) -> DataFrame:
    """``old`` merged with ``new``: new non-null values win, but never in ``keep_old`` columns; new keys are added."""
    rest = [c for c in old.columns if c not in key]
    other = new.select(*key, *[(F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType)).alias(f"_n_{c}") for c in rest])
    joined = old.join(other, key, "full_outer")
    pick = lambda c: F.coalesce(c, f"_n_{c}") if c in (keep_old or []) else F.coalesce(f"_n_{c}", c)
    return joined.select(*key, *[pick(c).alias(c) for c in rest])


def get_or_create(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """``jobs`` after the requests: one job for an identity (input_hash, config_hash, model_hash); a known one keeps its id and state and takes output and priority.

    Ids are hashes of the identity, so repeated runs agree.
    """
    identity = ["input_hash", "config_hash", "model_hash"]
    once = latest(asked, identity, [F.col("request_id")]).select(*identity, F.sha2(F.concat_ws("|", *identity).cast("binary"), 256).alias("job_id"), "output", "priority", F.lit("discovered").alias("state"))
    return upsert(jobs.select(*identity, "job_id", "output", "priority", "state"), once, identity, keep_old=["job_id", "state"])


def page(rows: DataFrame, order: list[Column], limit: int, lo: int = 1, hi: int = 10_000) -> DataFrame:
    """The first rows in an order; the limit is kept within bounds. Plans as a top-k, not a full sort."""
    return rows.orderBy(*order).limit(max(lo, min(hi, limit)))


def execution_hash(config: dict, models: dict) -> str:
    """SHA-256 of canonical JSON, on the driver: configurations are small."""
    import hashlib

    return hashlib.sha256(json.dumps({"config": config, "models": models}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def reusable(done: DataFrame, asked: DataFrame, fields: tuple[str, ...] = ("input_hash", "config_hash", "model_hash", "output_hash", "size", "version")) -> DataFrame:
    """asked's job_id with reuse: every field equals the finished manifest's."""
    d = done.select("job_id", *[F.col(f).alias(f"_d_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.coalesce(F.col(f) == F.col(f"_d_{f}"), F.lit(False))
    return asked.join(d, "job_id", "left").select("job_id", same.alias("reuse"))


def stage_times(timings: DataFrame) -> DataFrame:
    """job_id, stage, seconds, runs."""
    return timings.groupBy("job_id", "stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("runs"))
