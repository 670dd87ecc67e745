"""Streams of probed media: soft subtitles and their extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File extensions of subtitle codecs; any other becomes mks.
EXTENSIONS = {"subrip": "srt", "ass": "ass", "ssa": "ssa", "webvtt": "vtt"}


def extraction_plan(streams: DataFrame, key: str) -> DataFrame:
    """key, stream, file for each subtitle stream, numbered in order of its index."""
    ext = F.coalesce(_extension(), F.lit("mks"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("stream")) - 1
    return streams.where(F.col("codec_type") == "subtitle").select(key, "stream", F.format_string("subtitle_%02d_%d.%s", n, F.col("stream"), ext).alias("file"))


def _extension() -> Column:
    out = F.lit(None).cast("string")
    for codec, ext in EXTENSIONS.items():
        out = F.when(F.col("codec_name") == codec, ext).otherwise(out)
    return out


def without_subtitles(streams: DataFrame) -> DataFrame:
    return streams.where(F.col("codec_type") != "subtitle")


def soft_subtitled(media: DataFrame, streams: DataFrame, key: str) -> DataFrame:
    """Media with a soft subtitle stream, which need no frame to be read."""
    return media.join(streams.where(F.col("codec_type") == "subtitle").select(key), key, "left_semi")


def first_video(streams: Column) -> Column:
    return F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(1))
