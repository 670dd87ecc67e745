"""Shards by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
``(2 * rank + 1) / (2 * rows of its source)``. In order of fractional rank every stretch of rows has the
mixture of the whole, and equal cuts of that order are the shards: their counts are at most one apart.

Both rankings are made in buckets (of the hash, then of the fractional rank) that hold a few hundred rows each,
with the rows of earlier buckets added; no source is ever ranked in one task. Repeated rows are ranked as one row with
their number, so they don't meet in a bucket either.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import Tables, running, source_key

ROWS_PER_BUCKET = 512


def interleave(docs: DataFrame, shards: int = 40, seed: int = 29, rows_per_bucket: int = ROWS_PER_BUCKET, id_col: str = "doc_id", text: str = "text", source: str = "source", overhead: int = 16) -> DataFrame:
    """A row for each document: id, source, size (UTF-8 bytes and ``overhead``), text_crc32, shard, slot.

    slot counts from 0 in each shard without gaps. Null text has no bytes and the CRC of the empty text; null is a source
    of its own. Equal rows are told apart only by their places. Fewer rows than shards leave some shards empty.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    total = docs.count()
    buckets = max(1, ceil(total / rows_per_bucket))
    whole = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(F.col(id_col), F.col(text), F.lit(seed))
    light = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), source_key(F.col(source)).alias("sk"), (F.octet_length(whole) + overhead).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"), h.alias("h"))
    light = light.groupBy(*light.columns).agg(F.count("*").alias("n"))
    light = tables.write(light.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 11) / float(1 << 53)) * buckets)))

    counts = tables.write(light.groupBy("sk", "bucket").agg(F.sum("n").alias("n")))
    counts = running(counts, ["sk"], "bucket", "n", "ahead").join(counts.groupBy("sk").agg(F.sum("n").alias("of")), "sk").select("sk", "bucket", "ahead", "of")
    # shiftrightunsigned orders as the unsigned hash does
    earlier = F.sum("n").over(Window.partitionBy("sk", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1))
    rank = F.col("ahead") + F.coalesce(earlier, F.lit(0))
    ranked = light.join(counts, ["sk", "bucket"]).select("id", "source", "sk", "size", "crc", "n", rank.alias("first"), "of")
    ranked = ranked.select("id", "source", "sk", "size", "crc", "of", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    share = (2 * F.col("rank") + 1) / (2 * F.col("of"))
    ranked = tables.write(ranked.select("*", share.alias("share"), F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("block")))
    tables.drop(light)

    blocks = running(ranked.groupBy("block").agg(F.count("*").alias("n")), [], "block", "n", "before")
    at = F.row_number().over(Window.partitionBy("block").orderBy("share", "sk", "rank")) - 1 + F.col("before")
    placed = ranked.join(blocks, "block").select("id", "source", "size", "crc", at.cast("long").alias("at"))
    n = F.lit(max(total, 1)).cast("long")
    shard = F.floor(F.col("at") * shards / n) if total * shards < 1 << 53 else F.expr(f"at * {shards} div {total}")
    placed = placed.withColumn("shard", shard.cast("int"))
    # exact in integers: the division above may round up just below a whole number
    first = lambda s: F.expr(f"({s} * {total}L + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", F.when(F.col("at") < first("shard"), F.col("shard") - 1).otherwise(F.col("shard")))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - first("shard")).alias("slot"))
