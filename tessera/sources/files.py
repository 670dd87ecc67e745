"""Input files: scans of folders, hashes, model verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = (".mp4", ".mkv", ".mov", ".m4v", ".avi", ".webm", ".ts", ".m2ts", ".mts", ".flv", ".wmv", ".mpg", ".mpeg")


def media_only(files: DataFrame, suffixes: tuple[str, ...] = MEDIA, path: str = "path") -> DataFrame:
    """Files of a known suffix, whatever its case."""
    return files.where(F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1)).isin(*suffixes))


def scan(spark: SparkSession, path: str, recursive: bool = False, suffixes: tuple[str, ...] = MEDIA, content: bool = False) -> DataFrame:
    """Files below ``path``: path, modificationTime, length, and content if asked; sorted by path. Content is read only then."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    columns = ["path", "modificationTime", "length", *(["content"] if content else [])]
    return media_only(found.select(*columns), suffixes).orderBy("path")


def with_hash(files: DataFrame, mode: str = "full") -> DataFrame:
    """With hash by mode: none (of the path), fast (size, time and edges), full."""
    from tessera.functions.media import fast_hash

    if mode == "none":
        return files.withColumn("hash", F.concat(F.lit("path:"), "path"))
    if mode in ("fast", "fast_then_full"):
        return files.withColumn("hash", fast_hash(F.col("length"), F.unix_micros("modificationTime"), F.col("content")))
    if mode == "full":
        return files.withColumn("hash", F.sha2("content", 256))
    raise ValueError(f"unknown hash mode {mode}")


def verify_models(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """model, ok, problems: every file of the manifest (model, path, sha256, bytes) must be there with its hash and size.

    ``files``: path, sha256, bytes. A null hash or size in the manifest is not checked.
    """
    got = files.select(F.col("path").alias("_p"), F.col("sha256").alias("_s"), F.col("bytes").alias("_b"))
    checked = manifest.join(got, manifest["path"] == got["_p"], "left")
    problem = F.when(F.col("_p").isNull(), F.concat(F.lit("missing: "), "path")).when(F.col("bytes") != F.col("_b"), F.concat(F.lit("size: "), "path")).when(F.lower("sha256") != F.lower("_s"), F.concat(F.lit("hash: "), "path"))
    return checked.withColumn("_problem", problem).groupBy("model").agg((F.count("_problem") == 0).alias("ok"), F.array_sort(F.collect_list("_problem")).alias("problems"))
