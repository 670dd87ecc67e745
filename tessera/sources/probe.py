"""Probe reports (JSON of an external prober) as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import media as m
from tessera.sources.streams import first_video

SCHEMA = """struct<format:struct<duration:string>,chapters:array<map<string,string>>,streams:array<struct<
  index:int,codec_type:string,codec_name:string,time_base:string,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,duration:string,start_time:string,width:int,height:int,pix_fmt:string,
  profile:string,color_transfer:string,color_primaries:string,color_space:string,color_range:string,field_order:string,tags:map<string,string>,disposition:map<string,int>,side_data_list:array<map<string,string>>>>>"""
HDR_TRANSFERS = ("smpte2084", "arib-std-b67", "smpte428")
HDR_SIDE_DATA = ("Mastering display metadata", "Content light level metadata", "HDR Dynamic Metadata SMPTE2094-40 (HDR10+)")
INTERLACED = ("tt", "bb", "tb", "bt")


def parse(reports: DataFrame, json_col: str = "json") -> DataFrame:
    """With probe columns; a report without a video stream has ``ok`` false and null columns.

    Variable frame rate: average and nominal rates differ by over 0.5 %, or the frame count is off by over 2 and 1 %.
    """
    p = reports.withColumn("_p", F.from_json(json_col, SCHEMA.replace("\n", ""))).withColumn("_v", first_video(F.col("_p.streams")))
    v = F.col("_v")
    p = p.withColumn("_avg", m.ratio(m.rational(v["avg_frame_rate"]))).withColumn("_nom", m.ratio(m.rational(v["r_frame_rate"])))
    own = m.seconds_to_us(v["duration"])
    p = p.withColumn("duration_us", F.when(own != 0, own).otherwise(m.seconds_to_us(F.col("_p.format.duration"))))
    avg, nom = F.col("_avg"), F.col("_nom")
    rates = (avg > 0) & (nom > 0) & (F.abs(avg - nom) / F.greatest(avg, nom, F.lit(1e-12)) > 0.005)
    estimate = F.bround(F.col("duration_us") / 1e6 * avg).cast("bigint")
    off = (F.col("duration_us") > 0) & (avg > 0) & (F.abs(v["nb_frames"].try_cast("bigint") - estimate) > F.greatest(F.lit(2).cast("bigint"), (estimate * 0.01).cast("bigint")))
    side = F.coalesce(v["side_data_list"], F.array().cast("array<map<string,string>>"))
    hdr = F.coalesce(v["color_transfer"].isin(*HDR_TRANSFERS), F.lit(False)) | F.exists(side, lambda x: F.coalesce(x["side_data_type"].isin(*HDR_SIDE_DATA), F.lit(False)))
    out = p.select(
        *reports.columns, v.isNotNull().alias("ok"), "duration_us", v["width"].alias("width"), v["height"].alias("height"), m.rational(v["avg_frame_rate"]).alias("average_rate"), m.rational(v["time_base"], (1, 1_000_000)).alias("time_base"),
        F.when(v["index"].isNotNull(), F.coalesce(avg, F.lit(0.0))).alias("fps"), (F.coalesce(rates, F.lit(False)) | F.coalesce(off, F.lit(False))).alias("is_vfr"), hdr.alias("is_hdr"), F.coalesce(F.lower(v["field_order"]).isin(*INTERLACED), F.lit(False)).alias("is_interlaced"),
        m.rotation(v["tags"]["rotate"], F.transform(side, lambda x: x["rotation"])).alias("rotation"), m.seconds_to_us(v["start_time"]).alias("start_time_us"),
        F.exists(F.col("_p.streams"), lambda s: s["codec_type"] == "subtitle").alias("has_soft_subtitles"), F.col("_p.streams").alias("streams"), F.col("_p.chapters").alias("chapters"),
    )
    return out


