"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Tables as Tables
from tessera.sources.shared import shared_dir as shared_dir

#: What stands between words in the two tokenisations that the operators use.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; plain ``lower`` where the text is ASCII, which is much faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def source_key(source: Column) -> Column:
    """A key that is never null and orders as the sources do, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


#: So many texts of a batch are Python's at a time.
AT_ONCE = 128


def utf8(texts: pa.Array) -> Iterator[bytes | None]:
    """Each text's UTF-8 bytes, a few texts at a time: a batch is never held twice."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    for at in range(0, len(texts), AT_ONCE):
        yield from texts.slice(at, AT_ONCE).cast(kind).to_pylist()


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches that go to Python have about so many bytes at most, in what runs inside; the session's own limit holds again after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Stretches of an order are at most so many, as their bounds pass through the driver; beyond, they hold more rows.
MAX_BLOCKS = 20_000


#: A running sum is made in stretches of so many places, then over stretches.
STRETCH = 4096


def running(counts: DataFrame, by: list[str], at: str, n: str, to: str) -> DataFrame:
    """``counts`` with the long ``to``: the sum of ``n`` at smaller whole places ``at`` of the same ``by``.

    Two steps, so that what meets in one task is a stretch of places, then one row for each stretch.
    """
    stretch, before = F.floor(F.col(at) / STRETCH).cast("long").alias("_stretch"), (Window.unboundedPreceding, -1)
    cut = counts.select("*", stretch)
    sums = cut.groupBy(*by, "_stretch").agg(F.sum(n).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_stretch").rowsBetween(*before))
    sums = sums.select(*by, "_stretch", F.coalesce(ahead, F.lit(0)).cast("long").alias("_ahead"))
    inside = F.sum(n).over(Window.partitionBy(*by, "_stretch").orderBy(at).rowsBetween(*before))
    return cut.join(sums, [*by, "_stretch"]).select(*[c for c in counts.columns], (F.col("_ahead") + F.coalesce(inside, F.lit(0))).cast("long").alias(to))


def block_of(cuts: Column, n: int, key: Column, below: bool) -> Column:
    """How many of the ``n`` sorted ``cuts`` are less than ``key`` (or, not ``below``, at most it): a binary search in log n steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")

    def step(at: Column, s: Column) -> Column:
        cut = F.try_element_at(cuts, at + s)
        return F.when((at + s <= n) & F.coalesce(cut < key if below else cut <= key, F.lit(False)), at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


#: A table of more bytes is never dealt out again.
SMALL_TABLE = 1 << 30


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; a small one in fewer partitions than there are cores is dealt out to all of them, as the text work in a row outweighs its shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    run, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    small = int(run.optimizedPlan().stats().sizeInBytes()) <= SMALL_TABLE
    return df.repartition(cores) if small and run.toRdd().getNumPartitions() < cores else df
