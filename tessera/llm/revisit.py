"""WARC not-modified revisits resolved against the full responses that they stand for.

A revisit (a 304 capture) has headers but no body. An as-of join by canonical url finds the latest full response
strictly earlier; among responses of one time the largest record id counts. Validators are then checked, and the headers that a
304 may update are merged into the stored ones; all others keep the stored value, as a cache must.

The as-of join works on (url, stretch of time) groups. Stretches hold about ``rows_per_block`` captures of the whole
crawl, so a url with a third of all captures is spread over as many tasks as its captures need; what a
stretch starts with is carried over from the latest response of earlier stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import MAX_BLOCKS, Tables, block_of

#: Header fields that a 304 may update, in lower case; RFC 9110 lists those that it should send.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def canonical(url: Column) -> Column:
    """host/path?query: host in lower case without www. and default port, no slash at the end, no fragment, query sorted without utm_ parameters; null for null or without ``://``."""
    parts = r"(?s)^[^:/?#]+://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.regexp_replace(F.translate(F.regexp_extract(url, parts, 1), _UPPER, _UPPER.lower()), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, parts, 3), "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.when(url.rlike(r"(?s)^[^:/?#]+://"), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _lowered(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only, the one that sorts last stays."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda a, x: F.map_concat(F.map_filter(a, lambda k, _: k != F.lower(x["key"])), F.create_map(F.lower(x["key"]), x["value"])))


def resolve(captures: DataFrame, permitted: tuple[str, ...] = PERMITTED, rows_per_block: int = 4096, payload: str | None = None) -> DataFrame:
    """A row for each capture: record_id, url_key, kind, outcome, source_id, status, headers; ``payload`` too if it names a column.

    ``captures``: record_id long, url string, ts long, kind (response or revisit), status int, digest string, headers map.
    outcome: ``full`` (a response, as it is), ``resolved`` (validators agree: status, digest and body of the source, merged
    headers), ``unvalidated`` (the same, but there is no validator that both sides have), ``mismatch`` (a validator
    differs: nothing is merged), ``missing`` (no earlier full response, or no canonical url, or no time). Validators, the first
    that both have: etag (compared weakly), last-modified, digest. A full response is one of status 200; other responses
    are passed on as ``full`` but resolve nothing. Null headers are none. Repeated rows each give a row.
    """
    spark = captures.sparkSession
    tables = Tables(spark)
    head = _lowered(F.col("headers"))
    base = captures.select("record_id", "url", "ts", "kind", "status", "digest", head.alias("headers"), canonical(F.col("url")).alias("url_key"))
    base = tables.write(base.withColumn("can", F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isNotNull()))
    total = base.where("can").count()
    blocks = min(MAX_BLOCKS, max(1, -(-total // rows_per_block)))
    cuts = sorted(set(base.where("can").agg(F.approx_percentile("ts", [i / blocks for i in range(1, blocks)], 4 * blocks)).first()[0])) if blocks > 1 else []
    timed = base.where("can").crossJoin(F.broadcast(spark.createDataFrame([(cuts,)], "cuts array<bigint>")))
    timed = timed.withColumn("block", block_of(F.col("cuts"), len(cuts), F.col("ts"), below=False)).drop("cuts")

    full = (F.col("kind") == "response") & (F.col("status") == 200)
    about = F.struct(F.col("record_id").alias("id"), "status", "digest", "headers")
    when = F.when(full, F.struct("ts", "record_id"))
    last = timed.where(full).groupBy("url_key", "block").agg(F.max_by(about, when).alias("latest"))
    # the latest of the stretch before, for each stretch with captures of the url
    spans = timed.select("url_key", "block").distinct().join(last, ["url_key", "block"], "left")
    carried = F.last("latest", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    spans = tables.write(spans.select("url_key", "block", carried.alias("carried")).where("carried is not null"))
    near = F.max_by(about, when).over(Window.partitionBy("url_key", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    joined = timed.withColumn("near", near).join(spans, ["url_key", "block"], "left").withColumn("source", F.coalesce("near", "carried"))
    every = joined.select("record_id", "url_key", "kind", "status", "digest", "headers", "source").unionByName(base.where(~F.col("can")).select("record_id", "url_key", "kind", "status", "digest", "headers", F.lit(None).cast(joined.schema["source"].dataType).alias("source")))

    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("source.headers")
    agree = F.coalesce(tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"], F.col("digest") == F.col("source.digest"))
    revisit = F.col("kind") == "revisit"
    outcome = F.when(~F.coalesce(revisit, F.lit(False)), "full").when(F.col("source").isNull(), "missing").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    use = F.col("outcome").isin("resolved", "unvalidated")
    update = F.map_filter(mine, lambda k, v: k.isin(*permitted) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(update, k)), update)
    out = every.withColumn("outcome", outcome).select(
        "record_id", "url_key", "kind", "outcome", F.when(use, F.col("source.id")).alias("source_id"), F.when(use, F.col("source.status")).otherwise(F.col("status")).alias("status"),
        F.when(use, F.col("source.digest")).otherwise(F.col("digest")).alias("digest"), F.when(use, merged).otherwise(mine).alias("headers"),
    )
    if payload is None:
        return out
    bodies = captures.where((F.col("kind") == "response") & (F.col("status") == 200)).groupBy("record_id").agg(F.first(payload).alias("_stored"))
    own = captures.groupBy(F.col("record_id").alias("_own_id")).agg(F.first(payload).alias("_own"))
    out = out.join(bodies.withColumnRenamed("record_id", "_id"), F.col("source_id") == F.col("_id"), "left").join(own, F.col("record_id").eqNullSafe(F.col("_own_id")), "left")
    return out.select("record_id", "url_key", "kind", "outcome", "source_id", "status", "digest", "headers", F.when(F.col("source_id").isNotNull(), F.col("_stored")).otherwise(F.col("_own")).alias(payload))
