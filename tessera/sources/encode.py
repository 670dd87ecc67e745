"""Encoder choice. The encoding itself is an external program's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoders of each codec in order of preference.
ENCODERS = {"h264": ["h264_nvenc", "h264_qsv", "h264_videotoolbox", "h264_amf", "libx264"], "h265": ["hevc_nvenc", "hevc_qsv", "hevc_videotoolbox", "hevc_amf", "libx265"], "av1": ["av1_nvenc", "av1_qsv", "av1_amf", "libsvtav1", "libaom-av1"]}
HARDWARE = ("_nvenc", "_qsv", "_videotoolbox", "_amf")


def choose_encoder(jobs: DataFrame, available: DataFrame, key: list[str]) -> DataFrame:
    """With encoder: the first of the codec's that is available, software ones only if ``software_only``; null if there is none."""
    spark = jobs.sparkSession
    rows = [(codec, rank, name, name.endswith(HARDWARE)) for codec, names in ENCODERS.items() for rank, name in enumerate(names)]
    known = spark.createDataFrame(rows, "codec string, rank int, encoder string, hardware boolean").join(available.select("encoder").distinct(), "encoder", "left_semi")
    fit = jobs.join(F.broadcast(known), "codec", "left")
    ok = F.col("encoder").isNotNull() & ~(F.col("software_only") & F.col("hardware"))
    return fit.groupBy(*key, "codec").agg(F.min_by(F.when(ok, F.col("encoder")), F.when(ok, F.col("rank"))).alias("encoder"))


def first_success(attempts: DataFrame, key: list[str]) -> DataFrame:
    """Of ordered attempts (rank, ok, output) the first that worked; null output where all failed."""
    return attempts.groupBy(*key).agg(F.min_by(F.when(F.col("ok"), F.col("output")), F.when(F.col("ok"), F.col("rank"))).alias("output"), F.count_if(~F.col("ok")).alias("failures"))
