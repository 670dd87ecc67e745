"""Segment checkpoints and run tables, kept as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("job_id", "segment_id")


def write(frames: DataFrame, path: str) -> None:
    """Frames of segments (job_id, segment_id, frame_index, pts_us, pixels); a segment's earlier checkpoint is replaced as a whole."""
    counted = frames.repartition(*PARTS).sortWithinPartitions(*PARTS, "pts_us")
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def valid(checkpoints: DataFrame, manifest: DataFrame) -> DataFrame:
    """job_id, segment_id, valid: as many frames as the manifest (job_id, segment_id, frames) says, and not none."""
    n = checkpoints.groupBy(*PARTS).agg(F.count("*").alias("_n"))
    return manifest.join(n, list(PARTS), "left").select(*PARTS, (F.coalesce("_n", F.lit(0)) > 0).alias("_some"), (F.col("_n") == F.col("frames")).alias("_all")).select(*PARTS, (F.col("_some") & F.coalesce("_all", F.lit(False))).alias("valid"))


def pending(segments: DataFrame, checkpoints: DataFrame, manifest: DataFrame) -> DataFrame:
    """Segments without a valid checkpoint: what a resumed run still has to do."""
    return segments.join(valid(checkpoints, manifest).where("valid"), list(PARTS), "left_anti")
