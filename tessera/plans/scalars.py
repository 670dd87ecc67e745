"""Queries over scalar expressions (B01-B26, A01, A07-A09, A18-A20) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import media as m
from tessera.plans.registry import query
from tessera.plans.views import duck, view

W, H = 1920, 1080
DET = duck("v_detections")
CLAMP = "greatest(0, least({w}, {a}))"


def detections(spark, sf_dir):
    return view(spark, sf_dir, "v_detections")


def _named(b):
    return [c.cast("bigint").alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]


def _clamp_sql(x1, y1, x2, y2, w=W, h=H):
    a, b = f"greatest(0, least({w}, {x1}))", f"greatest(0, least({h}, {y1}))"
    return f"cast({a} as bigint) x1, cast({b} as bigint) y1, cast(greatest({a}, least({w}, {x2})) as bigint) x2, cast(greatest({b}, least({h}, {y2})) as bigint) y2"


@query(DET + f"select det_id, {_clamp_sql('x1 - 300', 'y1 + 200', 'x2 + 900', 'y2 + 250')} from v_detections")
def b01_clamp(spark, sf_dir):
    x1, y1, x2, y2 = g.box()
    return detections(spark, sf_dir).select("det_id", *_named(g.clamp((x1 - 300, y1 + 200, x2 + 900, y2 + 250), W, H)))


@query(DET + f"select det_id, {_clamp_sql('x1 - 27', 'y1 - 27', 'x2 + 27', 'y2 + 27', W, 880)} from v_detections")
def b02_expand(spark, sf_dir):
    return detections(spark, sf_dir).select("det_id", *_named(g.expand(g.box(), 27, W, 880)))


_PAIRS = """, p as (select a.det_id a, b.det_id b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) u from v_detections a join v_detections b on a.job_id = b.job_id and a.frame_index = b.frame_index and a.det_id < b.det_id)"""


@query(DET + _PAIRS + " select a, b, round(case when u - i > 0 then i / (u - i) else 0 end, 9) iou from p")
def b03_iou_pairs(spark, sf_dir):
    d = detections(spark, sf_dir)
    a, b = (d.select("job_id", "frame_index", *[F.col(c).alias(f"{p}{c}") for c in ("det_id", "x1", "y1", "x2", "y2")]) for p in ("a_", "b_"))
    pairs = a.join(b, ["job_id", "frame_index"]).where("a_det_id < b_det_id")
    return pairs.select(F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), F.round(g.iou(g.box("a_"), g.box("b_")), 9).alias("iou"))


@query(DET + "select det_id, (x1 + x2) / 2.0::double cx, (y1 + y2) / 2.0::double cy, round(degrees(atan2((det_id % 7)::double, (det_id % 5 + 1)::double)), 9) angle from v_detections")
def b04_center_b05_angle(spark, sf_dir):
    cx, cy = g.center(g.box())
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(pt(F.lit(3), F.lit(4)), pt(F.col("det_id") % 5 + 4, F.col("det_id") % 7 + 4))
    return detections(spark, sf_dir).select("det_id", cx.alias("cx"), cy.alias("cy"), F.round(g.polygon_angle(points), 9).alias("angle"))


@query(DET + "select det_id, cast(trunc(x1 - 0.6) as bigint) x1, cast(trunc(y1 + 0.25) as bigint) y1, cast(trunc(x2 + 0.9) as bigint) + 1 x2, cast(trunc(y2 + 0.5) as bigint) + 1 y2 from v_detections")
def b06_polygon_box(spark, sf_dir):
    x1, y1, x2, y2 = g.box()
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(pt(x1 - 0.6, y1 + 0.25), pt(x2 + 0.9, y1 + 0.3), pt(x2 + 0.1, y2 + 0.5), pt(x1 + 0.0, y2 - 0.5))
    return detections(spark, sf_dir).select("det_id", *_named(g.polygon_box(points)))


@query("""select event_id, case when event_id % 11 = 0 then 25 when event_id % 7 = 0 then 25 else 24000 + event_id % 10 end num, case when event_id % 11 = 0 or event_id % 7 = 0 then 1 else 1001 end den,
  round(case when event_id % 11 = 0 or event_id % 7 = 0 then 25.0::double else (24000 + event_id % 10) / 1001.0::double end, 9) fps from events""")
def b07_rational(spark, sf_dir):
    id_ = F.col("event_id")
    text = F.when(id_ % 11 == 0, "0/0").when(id_ % 7 == 0, "N/A").otherwise(F.concat((24000 + id_ % 10).cast("string"), F.lit("/1001")))
    r = m.rational(text, (25, 1))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", r["num"].alias("num"), r["den"].cast("int").alias("den"), F.round(m.ratio(r), 9).alias("fps"))


@query("""select event_id, cast(case when event_id % 13 = 0 then 0 else round_even("value" * 1000000, 0) end as bigint) us,
  cast(case when event_id % 9 = 0 then event_id else round_even(event_id * 1001 / 30000.0::double * 1000000, 0) end as bigint) pts_us from events""")
def b08_seconds_b09_pts(spark, sf_dir):
    id_ = F.col("event_id")
    pts = m.pts_to_us(id_.cast("double"), F.lit(1001), F.when(id_ % 9 != 0, F.lit(30000)), id_)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", m.seconds_to_us(F.when(id_ % 13 == 0, "N/A").otherwise(F.col("value").cast("string"))).alias("us"), pts.alias("pts_us"))


@query("""select event_id, cast(case event_id % 4 when 0 then (90 * (event_id % 6)) % 360 when 1 then (360 - (event_id % 360)) % 360 when 2 then 0 else event_id % 360 end as bigint) rotation from events""")
def b10_rotation(spark, sf_dir):
    id_ = F.col("event_id")
    tag = F.when(id_ % 4 == 0, (90 * (id_ % 6)).cast("string")).when(id_ % 4 == 3, F.lit("left"))
    side = F.when(id_ % 4 == 1, F.array((-(id_ % 360)).cast("string"))).when(id_ % 4 == 3, F.array(F.lit("x"), (id_ % 360).cast("string"))).otherwise(F.array().cast("array<string>"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", m.rotation(tag, side).alias("rotation"))


@query(duck("v_frames") + "select source_pts, printf('%02d:%02d:%06.3f', pts_us // 3600000000, (pts_us // 60000000) % 60, round_even((pts_us % 60000000) / 1000.0::double, 0) / 1000.0::double) clock from v_frames")
def b11_clock(spark, sf_dir):
    return view(spark, sf_dir, "v_frames").select("source_pts", m.clock(F.col("pts_us")).alias("clock"))


@query("""select doc_id, sha256('{"a":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}') stable, sha256(text) content, octet_length(encode(text)) size from documents""")
def b12_b13_hashes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stable = m.canonical_json_hash(("source", m.quoted(F.col("source"))), ("a", F.col("n_chars").cast("string")), ("lang", m.quoted(F.col("lang"))))
    return d.select("doc_id", stable.alias("stable"), F.sha2(F.col("text").cast("binary"), 256).alias("content"), F.octet_length("text").cast("bigint").alias("size"))


@query("""select doc_id, sha256(encode(octet_length(encode(text))::varchar) || encode((doc_id * 1000)::varchar) || encode(text)) fast from documents where octet_length(encode(text)) <= 1048576""")
def b14_fast_hash(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("b", F.col("text").cast("binary"))
    return d.select("doc_id", m.fast_hash(F.octet_length("b"), F.col("doc_id") * 1000, F.col("b")).alias("fast"))


@query(DET + "select det_id, case det_id % 4 when 0 then 'subtitle' when 1 then 'uncertain' when 2 then 'logo' else 'overlay' end as class from v_detections where det_id % 4 in (0, 1, 3)")
def b15_removable(spark, sf_dir):
    from tessera.operators.masks import removable

    kind = F.element_at(F.array(*[F.lit(x) for x in ("subtitle", "uncertain", "logo", "overlay")]), (F.col("det_id") % 4 + 1).cast("int"))
    return detections(spark, sf_dir).withColumn("class", kind).where(removable(F.col("class"), "remove")).select("det_id", "class")


@query(DET + "select det_id, y1 + 100 height, case when y1 + 100 >= 900 then 5 else 3 end least, case when y1 + 100 >= 900 then 11 else 7 end most from v_detections")
def b16_dilation(spark, sf_dir):
    from tessera.operators.masks import dilation

    h = F.col("y1") + 100
    d = dilation(h)
    return detections(spark, sf_dir).select("det_id", h.alias("height"), d["least"].alias("least"), d["most"].alias("most"))


@query(DET + """select det_id, cast(round_even((900 + 0.00027 * p * f + 0.0025 * p + 4e-9 * p * p) * case when det_id % 3 = 0 then 1 else 1.45 end, 0) as bigint) mb
  from (select det_id, ((x2 - x1) * (y2 - y1))::double p, (det_id % 96)::double f from v_detections)""")
def b17_vram(spark, sf_dir):
    return detections(spark, sf_dir).select("det_id", m.vram_mb(g.area(g.box()).cast("double"), (F.col("det_id") % 96).cast("double"), F.col("det_id") % 3 == 0).alias("mb"))


@query(DET + """select det_id, abs(a * d - 0.25 * a) >= 0.15 and abs(a * d - 0.25 * a) <= 6 and det_id % 10 <> 0 ok from (select det_id, confidence * 3 a, (det_id % 8) / 4.0::double d from v_detections)""")
def b18_valid_transform(spark, sf_dir):
    a, d = F.col("confidence") * 3, (F.col("det_id") % 8) / 4.0
    bad = F.when(F.col("det_id") % 10 == 0, float("nan")).otherwise(0.0)
    ms = [a, F.lit(0.25) * a, bad, F.lit(1.0), d, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return detections(spark, sf_dir).select("det_id", g.valid_transform(ms).alias("ok"))


@query(DET + """select job_id, frame_index, cast(greatest(0, min(x1) - p) as bigint) x1, cast(greatest(0, min(y1) - p) as bigint) y1, cast(least(1920, max(x2) + p) as bigint) x2, cast(least(1080, max(y2) + p) as bigint) y2
  from (select *, case when job_id % 2 = 0 then 72 else 64 end p from v_detections) group by job_id, frame_index, p""")
def b19_inpaint_roi(spark, sf_dir):
    from tessera.operators.aggregate import box_union
    from tessera.operators.masks import inpaint_padding

    route = F.when(F.col("job_id") % 2 == 0, "official_propainter").otherwise("tbe_lama")
    u = box_union(detections(spark, sf_dir), ["job_id", "frame_index"])
    return u.select("job_id", "frame_index", *_named(g.expand(g.box(), inpaint_padding(route, F.lit(1080)), W, H)))


@query(DET + """select det_id, a x1, b y1, a + w x2, b + h y2 from (select det_id, w, h, cast(least(greatest(0, round_even((x1 + x2) / 2.0::double - w / 2.0::double, 0)), 1920 - w) as bigint) a, cast(least(greatest(0, round_even((y1 + y2) / 2.0::double - h / 2.0::double, 0)), 1080 - h) as bigint) b
  from (select *, least(1920, greatest(x2 - x1, 128)) w, least(1080, greatest(y2 - y1, 128)) h from v_detections))""")
def b20_minimum_roi(spark, sf_dir):
    return detections(spark, sf_dir).select("det_id", *_named(g.minimum_roi(g.box(), W, H)))


@query(duck("v_pixels") + """select frame_index, y, x, round(case when v <= 0.04045 then v / 12.92 else power((v + 0.055) / 1.055, 2.4) end, 9) linear, round(case when v <= 0.0031308 then v * 12.92 else 1.055 * power(v, 1 / 2.4) - 0.055 end, 9) encoded,
  cast(greatest(0, least(255, trunc(value * 1.3 - 20))) as bigint) byte from (select *, value / 255.0::double v from v_pixels)""")
def b21_srgb_b22_uint8(spark, sf_dir):
    v = F.col("value") / 255.0
    return view(spark, sf_dir, "v_pixels").select("frame_index", "y", "x", F.round(g.srgb_to_linear(v), 9).alias("linear"), F.round(g.linear_to_srgb(v), 9).alias("encoded"), g.uint8(F.col("value") * F.lit(1.3) - 20).cast("bigint").alias("byte"))


@query("select page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') name, starts_with(url, 'https://m.') or url = 'https://m' allowed from pages")
def b23_safe_name_b26_root(spark, sf_dir):
    from tessera.functions.media import safe_name

    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", safe_name(F.col("url")).alias("name"), (F.col("url").startswith("https://m.") | (F.col("url") == "https://m")).alias("allowed"))


@query("""select doc_id, m.under from (select doc_id, case when doc_id % 5 = 4 then false else source in ('src1', 'src2') end under from documents) m""")
def b26_allowed_root(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/data/"), F.col("source"), F.when(F.col("doc_id") % 5 == 4, "/../x").otherwise("/x"), F.col("doc_id").cast("string"))
    return d.select("doc_id", m.under_root(path, ["/data/src1", "/data/src2/"]).alias("under"))


@query("""select event_id, case when event_id % 3 = 0 then [event_id % 50, 5, event_id % 50 + 10, 40]::bigint[] end[3] right_, event_id % 3 = 0 valid from events""")
def b25_roi_parse(spark, sf_dir):
    id_ = F.col("event_id")
    good = F.concat_ws(",", (id_ % 50).cast("string"), F.lit(" 5"), (id_ % 50 + 10).cast("string"), F.lit("40 "))
    text = F.when(id_ % 3 == 0, good).when(id_ % 3 == 1, "1,2,3").otherwise("9,9,9,z")
    r = m.roi(text)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(r, 2).alias("right_"), r.isNotNull().alias("valid"))


@query("""select '/in/' || source || '/' || doc_id || ext path from (select *, case doc_id % 4 when 0 then '.MP4' when 1 then '.mkv' when 2 then '.txt' else '.webm' end ext from documents) where ext <> '.txt'""")
def a01_media_inputs(spark, sf_dir):
    from tessera.sources.files import media_only

    ext = F.element_at(F.array(*[F.lit(x) for x in (".MP4", ".mkv", ".txt", ".webm")]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"))
    return media_only(d)


_NAMES = """select event_id, case event_id % 5 when 0 then 'frame_' || event_id || '.png' when 1 then 'PTS_' || event_id || '.npy' when 2 then event_id || '.png' when 3 then 'mask_' || event_id || '.PNG' else 'other_' || event_id || '.png' end as name from events"""


@query(f"select event_id, case when event_id % 5 = 1 then 'pts' when event_id % 5 <> 4 then 'frame' end kind, case when event_id % 5 <> 4 then event_id end number from ({_NAMES})")
def a07_mask_names(spark, sf_dir):
    from tessera.sources.masks import numeric_token

    id_ = F.col("event_id").cast("string")
    name = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("frame_"), id_, F.lit(".png"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("PTS_"), id_, F.lit(".npy"))).when(F.col("event_id") % 5 == 2, F.concat(id_, F.lit(".png")))
    name = name.when(F.col("event_id") % 5 == 3, F.concat(F.lit("mask_"), id_, F.lit(".PNG"))).otherwise(F.concat(F.lit("other_"), id_, F.lit(".png")))
    t = numeric_token(name)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", t["kind"].alias("kind"), t["number"].alias("number"))


@query("""select user_id job_id, 'frame' kind, event_id number, 'p' || event_id path from events where event_id % 2 = 0 union all select user_id, 'pts', event_id, 'p' || event_id from events where event_id % 2 = 1""")
def a08_mask_manifest(spark, sf_dir):
    from tessera.sources.masks import manifest_entries

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("frame_"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("PTS_"), F.col("event_id").cast("string")))
    item = F.concat(F.lit('"'), key, F.lit('":"p'), F.col("event_id").cast("string"), F.lit('"'))
    mapping = e.groupBy(F.col("user_id").alias("job_id")).agg(F.concat(F.lit('{"frames":{'), F.array_join(F.collect_list(item), ","), F.lit("}}")).alias("json"))
    listed = e.groupBy(F.col("user_id").alias("job_id")).agg(F.concat(F.lit('{"frames":['), F.array_join(F.collect_list(F.concat(F.when(F.col("event_id") % 2 == 0, F.lit('{"frame_index":')).otherwise(F.lit('{"pts_us":')), F.col("event_id").cast("string"), F.lit(',"path":"p'), F.col("event_id").cast("string"), F.lit('"}'))), ","), F.lit("]}")).alias("json"))
    half = mapping.where("job_id % 2 = 0").unionByName(listed.where("job_id % 2 = 1"))
    return manifest_entries(half, "json").select("job_id", "kind", "number", "path")


@query("""select user_id job_id, frame_index, case when min(case when event_type = 'view' then 0 else 1 end) = 0 then 'manifest' else 'name' end source, min_by('p' || event_id, (case when event_type = 'view' then 0 else 1 end, event_id)) path
  from (select *, event_id % 40 frame_index from events) group by 1, 2""")
def a09_mask_resolution(spark, sf_dir):
    from tessera.sources.masks import resolve_sources

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 40).alias("frame_index"), F.when(F.col("event_type") == "view", "manifest").otherwise("name").alias("source"), F.col("event_id"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"))
    return resolve_sources(rows, ["job_id", "frame_index"], "event_id").select("job_id", "frame_index", "source", "path")


@query("""select source, sha256('[' || string_agg('{"relative":"' || doc_id || '","sha256":"' || sha256(text) || '","size":' || octet_length(encode(text)) || '}', ',' order by doc_id::varchar) || ']') digest from documents group by source""")
def a12_mask_digest(spark, sf_dir):
    from tessera.sources.masks import set_digest

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return set_digest(d, ["source"])


@query("""select event_id, case when event_id % 2 = 0 then 'libx264' else 'h264_qsv' end encoder from events""")
def a18_encoder_choice(spark, sf_dir):
    from tessera.sources.encode import choose_encoder

    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("h264").alias("codec"), (F.col("event_id") % 2 == 0).alias("software_only"))
    ready = spark.createDataFrame([("h264_qsv",), ("libx264",), ("libsvtav1",)], "encoder string")
    return choose_encoder(jobs, ready, ["event_id"]).select("event_id", "encoder")


@query("""select event_id, case event_id % 4 when 0 then 'mp4' when 1 then 'webm' else 'matroska' end family, case when event_id % 4 = 1 then 'av1' when event_id % 3 = 0 then 'h264' when event_id % 3 = 1 then 'h265' end codec from events""")
def a19_codec(spark, sf_dir):
    id_ = F.col("event_id")
    path = F.when(id_ % 4 == 0, "a/b.MOV").when(id_ % 4 == 1, "c.webm").when(id_ % 4 == 2, "d.mkv").otherwise("noext")
    fam = m.container_family(path)
    asked = F.when(id_ % 3 == 0, "auto").when(id_ % 3 == 1, "h265").otherwise(F.when(id_ % 4 == 1, "auto").otherwise("vp9"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fam.alias("family"), m.normal_codec(asked, fam).alias("codec"))


@query("""select user_id job_id, event_id stream, 'subtitle_' || printf('%02d', row_number() over (partition by user_id order by event_id) - 1) || '_' || event_id || '.' || case when event_id % 3 = 0 then 'srt' when event_id % 3 = 1 then 'ass' else 'mks' end file
  from events where event_type = 'click'""")
def a20_subtitle_streams(spark, sf_dir):
    from tessera.sources.streams import extraction_plan

    codec = F.when(F.col("event_id") % 3 == 0, "subrip").when(F.col("event_id") % 3 == 1, "ass").otherwise("dvd_subtitle")
    s = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("stream"), F.when(F.col("event_type") == "click", "subtitle").otherwise("video").alias("codec_type"), codec.alias("codec_name"))
    return extraction_plan(s, "job_id")


@query(duck("v_frames") + """select distinct job_id, pts_us from (select job_id, pts_us from v_frames where frame_index % 3 = 0 union all select job_id, pts_us from v_frames where frame_index % 4 = 0)""")
def g01_union_points(spark, sf_dir):
    f = view(spark, sf_dir, "v_frames").select("job_id", "pts_us", "frame_index")
    return f.where("frame_index % 3 = 0").unionByName(f.where("frame_index % 4 = 0")).select("job_id", "pts_us").distinct()


@query("""select c_custkey, case c_mktsegment when 'BUILDING' then 'BUILDING,cpu' else c_mktsegment || ',BUILDING,cpu' end backends from customer""")
def g02_ordered_distinct(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", F.array_join(F.array_distinct(F.array(F.col("c_mktsegment"), F.lit("BUILDING"), F.lit("cpu"), F.lit("BUILDING"))), ",").alias("backends"))


@query(DET + "select job_id, frame_index, cast(count(*) as bigint) n, cast(sum(det_id) as bigint) ids from (select * from v_detections where confidence > 0.5 union all select * from v_detections where det_id % 2 = 0) group by 1, 2")
def g03_bag_union(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.where("confidence > 0.5").unionByName(d.where("det_id % 2 = 0")).groupBy("job_id", "frame_index").agg(F.count("*").alias("n"), F.sum("det_id").alias("ids"))


@query(duck("v_pixels") + """, a as (select frame_index, y, x from v_pixels where masked = 1), b as (select frame_index, y, x from v_pixels where value > 120)
select 'union' op, frame_index, cast(count(*) as bigint) n from (select * from a union select * from b) group by 2 union all select 'difference', frame_index, cast(count(*) as bigint) from (select * from a except select * from b) group by 2""")
def g04_pixel_sets(spark, sf_dir):
    from tessera.operators.masks import pixel_difference, pixel_union

    p = view(spark, sf_dir, "v_pixels")
    a, b = p.where("masked = 1").select("frame_index", "y", "x"), p.where("value > 120").select("frame_index", "y", "x")
    count = lambda df, op: df.groupBy("frame_index").agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "frame_index", "n")
    return count(pixel_union(a, b), "union").unionByName(count(pixel_difference(a, b, ["frame_index", "y", "x"]), "difference"))


@query(DET + "select det_id from v_detections where det_id not in (select o_orderkey from orders where o_orderstatus = 'F')")
def g05_unmatched(spark, sf_dir):
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("det_id"))
    return detections(spark, sf_dir).select("det_id").join(done, "det_id", "left_anti")
