"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. A
document's word is hit if it lies inside any occurrence of a window.

1. Rarity: the occurrences of every benchmark word are counted over the whole corpus.
2. Prefix: an occurrence of a window holds all of its words, so one necessary token is enough, and the
   rarest is the cheapest. Windows whose rarest word never occurs can't occur.
3. Candidates: the positions of prefix tokens in each document, each with the words around it. Only
   these few rows leave the document; the text itself is never shuffled.
4. Verification: the token's place in the window fixes where the window would start. Windows that would start
   before the document or end after it are dropped, the rest are compared word by word.

The set of prefix tokens is held in the scan as a literal set while it has at most ``literal_limit`` tokens.
Beyond that each document's own tokens are found by a shuffled join on its distinct words instead.

No token meets in one task: candidates of a token that has over one in ``HOT`` of all occurrences (so at most ``HOT`` tokens)
are dealt out over ``SALTS`` copies of its windows, and the join on words deals every word out over ``SALTS`` documents' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import NOT_ALNUM, Tables, ascii_lower

LITERAL_LIMIT = 50_000
HOT, SALTS = 512, 32


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_ALNUM), ""), F.array().cast("array<string>"))


def _split_once(docs: DataFrame) -> DataFrame:
    # A Generate over one element keeps the split from being copied into each expression that reads it.
    return docs.select("*", F.explode(F.array(words_of(F.col("text")))).alias("words"))


def windows_of(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) for every window of every item."""
    items = _split_once(benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))).where(F.size("words") > 0)
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))).alias("s"))
    return starts.select("item", F.slice("words", F.col("s"), width).alias("words")).distinct()


def _token_rows(docs: DataFrame, tokens: DataFrame, limit: int) -> tuple[DataFrame, Column]:
    """``docs`` with their words, and the condition on a word ``w`` that it is one of ``tokens``."""
    held = [r[0] for r in tokens.limit(limit + 1).collect()]
    if len(held) <= limit:
        return docs, lambda w: w.isin(held) if held else F.lit(False)
    salted = docs.select("id", "th", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).alias("salt"), F.explode(F.array_distinct("words")).alias("token"))
    copies = tokens.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    own = salted.join(copies, ["token", "salt"]).groupBy("id", "th").agg(F.collect_set("token").alias("own"))
    own = own.select(F.col("id").alias("oid"), F.col("th").alias("oth"), "own")
    joined = docs.join(own, docs["id"].eqNullSafe(own["oid"]) & docs["th"].eqNullSafe(own["oth"]), "left")
    return joined.drop("oid", "oth"), lambda w: F.coalesce(F.array_contains(F.col("own"), w), F.lit(False))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, literal_limit: int = LITERAL_LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, text_hash, n_words, n_hit, items (sorted strings), contaminated.

    contaminated: ``n_hit > 0 and share * n_hit >= n_words``. Repeated rows each give a row, rows of one id and
    different texts are judged apart, null ids are allowed. Null and empty texts have no words; items without
    words have no window. A null item id counts as the empty string.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    light = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    split = _split_once(light).select("id", F.xxhash64("text").alias("th"), "words")
    windows = tables.write(windows_of(benchmark, width))
    vocabulary = tables.write(windows.select(F.explode("words").alias("token")).distinct())
    has, known = _token_rows(split, vocabulary, literal_limit)
    rarity = has.select(F.explode(F.filter("words", known)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    placed = windows.select("item", "words", F.posexplode("words").alias("j", "token")).join(rarity, "token")
    index = tables.write(placed.groupBy("item", "words").agg(F.min(F.struct("n", "token", "j")).alias("least"), F.count("*").alias("found")).where(F.col("found") == F.size("words")).select("item", "words", F.col("least.token").alias("token"), F.col("least.j").alias("j"), F.col("least.n").alias("n")))
    often = index.select("token", "n").distinct()
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = [r.token for r in often.where(F.col("n") * HOT > total).collect()]  # fewer than HOT
    is_hot = F.col("token").isin(hot) if hot else F.lit(False)
    index = index.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))

    has, wanted = _token_rows(split, tables.write(index.select("token").distinct()), literal_limit)
    at = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: wanted(F.element_at("words", i)))
    around = F.transform("at", lambda i: F.struct(i.alias("pos"), F.greatest(i - width + 1, F.lit(1)).alias("first"), F.slice("words", F.greatest(i - width + 1, F.lit(1)), 2 * width - 1).alias("near")))
    scanned = has.select("id", "th", "words", F.explode(F.array(F.when(F.size("words") > 0, at).otherwise(F.array().cast("array<int>")))).alias("at"))
    scanned = tables.write(scanned.select("id", "th", F.size("words").cast("long").alias("n_words"), around.alias("around")))

    near = scanned.select("id", "th", "n_words", F.explode("around").alias("c")).select("id", "th", "n_words", "c.*", F.element_at("c.near", F.col("c.pos") - F.col("c.first") + 1).alias("token"))
    near = near.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id", "th", "pos"), F.lit(SALTS))).otherwise(0).cast("int"))
    # pos and first count from 1, j from 0
    starts = F.col("pos") - F.col("j")
    fits = (starts >= F.col("first")) & (starts - 1 + F.size("words") <= F.col("n_words"))
    hits = near.join(index, ["token", "salt"]).where(fits & (F.slice("near", F.greatest(starts - F.col("first") + 1, F.lit(1)), F.size("words")) == F.col("words")))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["s"] + x["w"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["s"] + x["w"]).alias("end")),
        lambda a: a["n"],
    )
    by_doc = hits.groupBy("id", "th").agg(F.collect_set(F.struct(starts.cast("long").alias("s"), F.size("words").cast("long").alias("w"))).alias("spans"), F.collect_set("item").alias("items"))
    by_doc = by_doc.select(F.col("id").alias("hid"), F.col("th").alias("hth"), covered.alias("n_hit"), F.array_sort("items").alias("items"))
    base = scanned.select("id", "th", "n_words")
    out = base.join(by_doc, base["id"].eqNullSafe(by_doc["hid"]) & base["th"].eqNullSafe(by_doc["hth"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all of their columns."""
    bad = contamination(docs, benchmark, id_col=id_col, text=text, **options).where("contaminated")
    bad = Tables(docs.sparkSession).write(bad.select(F.col(id_col).alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text]) == bad["_bad_hash"]), "left_anti")
