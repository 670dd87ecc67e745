"""URL filters from association rules, with DataFrame functions and Spark's FP-growth only.

A url is reduced to at most ten tokens of distinct kinds (scheme, host, registered name, top level, first label, first directory,
leaf shape, extension, query keys, fragment). FP-growth mines frequent token combinations from labelled
urls; combinations whose share of a label reaches ``confidence`` at the least support become rules, and a rule that
a more general rule of no less confidence implies is pruned. As a url has at most one token of each kind, it has at most
2**10 combinations however long it is.

Rules match by an inverted index: a rule is filed under its rarest token only, urls look up their tokens there, and
what is found is verified to hold all of the rule's tokens. Urls with equal tokens are looked up once.

A list of (host, path) rules stands above what was mined: it fits a host and its subdomains where the path starts
with the rule's, and the longest host and path win.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Tables

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule (host, path, verdict) that fits; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """At most ten tokens, each of another kind."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    leaf = F.regexp_extract(path, r"([^/]*)/?$", 1)
    first = F.regexp_extract(path, r"^/([^/]+)/", 1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)))), "&")
    kinds = [
        ("scheme", F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), ("host", host), ("name", F.when(n >= 2, F.array_join(F.slice(labels, -2, 2), "."))), ("top", F.element_at(labels, -1)), ("sub", F.when(n >= 3, F.element_at(labels, 1))),
        ("dir", F.when(~first.rlike(r"^\d+$"), first)), ("leaf", F.when(leaf.rlike(r"^\d+$"), "number").when(leaf == "", "none").when(leaf.rlike(r"\d"), "mixed").otherwise("word")), ("ext", F.regexp_extract(leaf, r"\.([A-Za-z0-9]{1,8})$", 1)),
        ("query", keys), ("fragment", F.when(F.instr(url, "#") > 0, F.lit("yes"))),
    ]
    return F.array_compact(F.array(*[F.when((v != "") & (host != ""), F.concat(F.lit(f"{k}="), v)) for k, v in kinds]))


def mine(labelled: DataFrame, tables: Tables, least_support: float = 0.005, least_count: int = 20, confidence: float = 0.9) -> DataFrame:
    """(items, label, support, confidence, key) of every rule; ``labelled``: items, label. key is the rarest item."""
    total = labelled.count()
    out = "items array<string>, label string, n long, confidence double, key string"
    if not total:
        return labelled.sparkSession.createDataFrame([], out)
    baskets = labelled.select(F.concat(F.col("items"), F.array(F.concat(F.lit("label="), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least_support, least_count / total)), minConfidence=confidence).fit(baskets)
    sets = tables.write(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    is_label = lambda x: x.startswith("label=")
    whole = sets.where(F.exists("items", is_label) & (F.size("items") > 1)).select(F.filter("items", lambda x: ~is_label(x)).alias("items"), F.substring(F.element_at(F.filter("items", is_label), 1), 7, 1 << 30).alias("label"), F.col("freq").alias("n"))
    plain = sets.where(~F.exists("items", is_label)).select("items", F.col("freq").alias("of"))
    found = tables.write(whole.join(plain, "items").select("items", "label", "n", (F.col("n") / F.col("of")).alias("confidence")).where(F.col("confidence") >= confidence))
    # a rule goes if one with a token less says the same with no less confidence
    wider = found.where(F.size("items") > 1).select("items", "label", F.col("confidence").alias("own"), F.explode("items").alias("out")).select(F.array_remove("items", F.col("out")).alias("less"), "items", "label", "own")
    short = found.select(F.col("items").alias("less"), "label", F.col("confidence").alias("general"))
    implied = wider.join(short, ["less", "label"]).where(F.col("general") >= F.col("own")).select("items", "label").distinct()
    kept = found.join(implied, ["items", "label"], "left_anti")
    counts = plain.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "of")
    rare = kept.select("items", "label", F.explode("items").alias("item")).join(counts, "item").groupBy("items", "label").agg(F.min_by("item", F.struct("of", "item")).alias("key"))
    return tables.write(kept.join(rare, ["items", "label"]).select("items", "label", "n", "confidence", "key"))


def match(urls: DataFrame, rules: DataFrame, tables: Tables) -> DataFrame:
    """(items, best) for each distinct token array of ``urls`` that some rule fits; best: confidence, n, size, label, rule."""
    distinct = urls.select("items").distinct()
    ask = distinct.select("items", F.explode("items").alias("key"))
    filed = rules.select("key", F.col("items").alias("rule"), "label", "n", "confidence")
    hits = ask.join(filed, "key").where(F.size(F.array_except("rule", "items")) == 0)
    best = F.struct("confidence", "n", F.size("rule").alias("size"), "label", F.array_join("rule", " ").alias("rule"))
    return tables.write(hits.groupBy("items").agg(F.max(best).alias("best")))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", label_id: str = "doc_id", bad: str = "toxic", default: str = "allow", **options) -> DataFrame:
    """A row for each page: id, host, path, rule (of the list, else null), verdict, mined (the mined rule that decided, else null), confidence.

    Urls are labelled block where a row of ``labels`` for the id has ``bad`` above 0 and allow where all have 0; the list's own verdicts train
    nothing, so a mined rule never echoes the list. Unlabelled urls train nothing. Null urls have empty host and path and the default
    verdict; a page that is labelled twice is bad if any label says so. Without labels nothing is mined.
    """
    tables = Tables(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    base = tables.write(base.select("id", "host", "path", listed(F.col("host"), F.col("path"), rules).alias("list"), F.coalesce(tokens(F.col("url"), F.col("host"), F.col("path")), F.array().cast("array<string>")).alias("items")))
    marks = labels.where(F.col(label_id).isNotNull() & F.col(bad).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.when(F.max(bad) > 0, "block").otherwise("allow").alias("mark"))
    labelled = base.where(F.size("items") > 0).join(marks, "id").select("items", F.col("mark").alias("label"))
    found = match(base, mine(tables.write(labelled), tables, **options), tables)
    out = base.join(found, "items", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("list.rule").alias("rule"), F.coalesce("list.verdict", "best.label", F.lit(default)).alias("verdict"), F.when(F.col("list").isNull(), F.col("best.rule")).alias("mined"), F.when(F.col("list").isNull(), F.col("best.confidence")).alias("confidence"))
