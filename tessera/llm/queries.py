"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, licenses, mixing, ordermin, revisit, sharding, simhash, tokencount, urlrules
from tessera.llm._shared import read

#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    base = F.transform("base", lambda x: x["label"])
    kept = F.filter("found", lambda x: x["kept"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    sure = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(kept, lambda x: x["confidence"])), F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(kept, lambda x: x["label"]))).alias("labels"), sure.alias("score"), F.size(kept).cast("long").alias("n_detections"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~F.coalesce(out, F.lit(True))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.array_join("language.languages", ",").alias("languages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compare_in_order(read(spark, sf_dir, "documents"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Two captures of each page, a stand-in for a crawl: a full response at minute page_id, and a later 304 of the url.

    The 304 has the page's etag, but a stale one where page_id is divisible by 5, and none where it is divisible by 11.
    """
    tag, at = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"')), F.col("page_id") * 60
    later = at + 30 + 6000 * (F.col("page_id") % 7)
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    stored = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length, F.lit("Date"), at.cast("string"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60"))
    sent = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Connection"), F.lit("close"), F.lit("Date"), later.cast("string"), F.lit("ETag"), F.when(F.col("page_id") % 11 == 0, F.lit(None)).when(F.col("page_id") % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("Cache-Control"), F.lit("max-age=120"))
    one = F.struct((F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), tag.alias("digest"), stored.alias("headers"))
    two = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("digest"), sent.alias("headers"))
    return pages.select(F.explode(F.array(one, two)).alias("x")).select("x.*")


def op7_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisit.resolve(captures_of(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit(": "), F.coalesce(x["value"], F.lit("")))), "\n")
    return done.select("record_id", "url_key", "outcome", "source_id", "status", shown.alias("headers"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_sharding, op3_license_scan, op4_language_id, op5_url_filter, op6_order_minhash, op7_warc_revisit,
        op8_benchmark_decontamination, op9_token_counts, op10_simhash_near_dedup,
    )
}

_WORDS = r"[x for x in string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"

ORACLES: dict[str, str] = {
    "op8_benchmark_decontamination": f"""
with d as (select doc_id, coalesce({_WORDS.format("text")}, []) w from documents),
b as (select cast(item_id as varchar) item, {_WORDS.format("text")} w from benchmark),
win as (select distinct item, array_to_string(list_slice(w, s, s + 12), ' ') k, least(len(w), 13) n
        from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s from b where len(w) > 0)),
pos as (select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') k
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, (select distinct n from win) where len(w) >= n)),
hit as (select doc_id, s, n, item from pos join win using (k, n)),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from hit) group by doc_id),
it as (select doc_id, count(distinct item) n_items, array_to_string(list_sort(list(distinct item)), ',') items from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cov using (doc_id) left join it using (doc_id)""",
    "op7_warc_revisit": r"""
with p as (select page_id, url, coalesce(html, '') html, '"' || md5(coalesce(html, '')) || '"' tag from pages),
c as (select page_id * 2 record_id, url, page_id * 60 ts, 'response' kind, tag, html, page_id from p
      union all
      select page_id * 2 + 1, url, page_id * 60 + 30 + 6000 * (page_id % 7), 'revisit',
        case when page_id % 11 = 0 then null when page_id % 5 = 0 then '"stale"' else 'W/' || tag end, html, page_id from p),
k as (select *, case when regexp_matches(url, '^[^:/?#]+://') then
        regexp_replace(regexp_replace(translate(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '')
        || coalesce('?' || nullif(array_to_string(list_sort([x for x in string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') if x <> '' and not starts_with(x, 'utm_')]), '&'), ''), '') end url_key from c),
r as (select v.*, s.record_id sid, s.tag stag, s.ts sts, octet_length(encode(s.html)) slen, row_number() over (partition by v.record_id order by s.ts desc, s.record_id desc) n
      from (select * from k where kind = 'revisit') v left join (select * from k where kind = 'response') s on v.url_key = s.url_key and s.ts < v.ts),
o as (select *, case when sid is null then 'missing' when tag is null then 'unvalidated' when regexp_replace(tag, '^W/', '') = stag then 'resolved' else 'mismatch' end outcome from r where n = 1)
select record_id, url_key, 'full' outcome, cast(null as bigint) source_id, 200 status,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || octet_length(encode(html)) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || tag headers
from k where kind = 'response'
union all
select record_id, url_key, outcome, case when outcome in ('resolved', 'unvalidated') then sid end, case when outcome in ('resolved', 'unvalidated') then 200 else 304 end,
  case when outcome in ('resolved', 'unvalidated')
    then 'cache-control: max-age=120' || chr(10) || 'content-length: ' || slen || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(tag, stag)
    else 'cache-control: max-age=120' || chr(10) || 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(tag, '') end
from o""",
}
