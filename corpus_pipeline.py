"""A corpus pipeline over ``documents``: each stage's result is written and read again as the next one's documents.

1. language: documents without an identified language go.
2. near_duplicates: one document of each near-duplicate group stays.
3. decontaminate: documents that hold benchmark passages go.
4. mix: documents are repeated or dropped until sources have their target weights.
5. shard: the mixture's documents in shards, each with the mixture of the whole.

All but the last return the columns of ``documents``. Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and further columns of any name, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, mixing, neartexts, sharding
from tessera.llm._shared import Tables, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter or has no language of a third of it. Each row is judged by its own text."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more of their sets of five-word shingles, the document of the smallest id stays.

    Null and empty texts are copies of each other; of rows that share the smallest id, or have none, the smallest row stays.
    """
    return neartexts.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lie in windows of benchmark items. Texts without words stay; each row is judged by its own text."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped to target weights. Null is a source of its own; a document without words is taken once; repeated rows count as often as they stand."""
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in one of 40 shards, their counts at most one apart. Null texts have no bytes; null is a source of its own; fewer rows than shards leave some empty."""
    return sharding.interleave(docs).select("doc_id", "source", F.col("size").alias("n_bytes"), "text_crc32", "shard", "slot")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: The learned language model and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = read(spark, sf_dir, "documents"), Tables(spark)
    for _, stage in STAGES:
        made = tables.write(stage(spark, docs, sf_dir))
        tables.drop(docs)
        docs = made
    return docs
