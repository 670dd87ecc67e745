"""Queries over detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import aggregate, masks, match, tracking, window
from tessera.plans.registry import query
from tessera.plans.scalars import DET, detections
from tessera.plans.views import detections_of, duck

_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREAS = "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))"


@query(DET + "select job_id, frame_index, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from v_detections group by 1, 2")
def d01_box_union(spark, sf_dir):
    return aggregate.box_union(detections(spark, sf_dir), ["job_id", "frame_index"])


@query(DET + """, f as (select distinct job_id, frame_index from v_detections where frame_index % 2 = 0) select d.det_id, d.job_id, d.frame_index from v_detections d join f using (job_id, frame_index)""")
def c01_detections_of_frames(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.join(d.where("frame_index % 2 = 0").select("job_id", "frame_index").distinct(), ["job_id", "frame_index"], "left_semi").select("det_id", "job_id", "frame_index")


@query(DET + "select job_id, frame_index, cast(count(*) as bigint) n from v_detections where det_id % 4 in (0, 1, 3) group by 1, 2")
def c02_removable_by_frame(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("subtitle", "uncertain", "logo", "overlay")]), (F.col("det_id") % 4 + 1).cast("int"))
    return detections(spark, sf_dir).where(masks.removable(kind)).groupBy("job_id", "frame_index").agg(F.count("*").alias("n"))


@query(duck("v_frames") + "select job_id, source_pts, case when source_pts % 3 = 0 then 'i' || frame_index when pts_us % 2 = 0 and source_pts % 5 = 0 then 'p' || pts_us end path from v_frames")
def c03_mask_lookup(spark, sf_dir):
    from tessera.plans.frames import frames

    f = frames(spark, sf_dir)
    by_index = f.where("source_pts % 3 = 0").select("job_id", "frame_index", F.concat(F.lit("i"), F.col("frame_index").cast("string")).alias("path"))
    by_pts = f.where("pts_us % 2 = 0 and source_pts % 5 = 0").select("job_id", "pts_us", F.concat(F.lit("p"), F.col("pts_us").cast("string")).alias("path"))
    return match.fallback_lookup(f, by_index, by_pts, ["job_id"]).select("job_id", "source_pts", "path")


@query(DET + "select det_id, x1 + 1 left_, y1 right_ from v_detections")
def c04_strict_zip(spark, sf_dir):
    d = detections(spark, sf_dir)
    return match.zip_strict(d.select("det_id", (F.col("x1") + 1).alias("left_")), d.select("det_id", F.col("y1").alias("right_")), ["det_id"])


@query(DET + f""", k as (select det_id, job_id, frame_index, x1 + 40 x1, y1, x2 + 40 x2, y2 from v_detections where det_id % 3 = 0), n as (select * from v_detections where det_id % 3 = 1)
select det_id from n a where not exists (select 1 from k b where a.job_id = b.job_id and a.frame_index = b.frame_index and {_IOU} > 0.08 * ({_AREAS} - {_IOU}))""")
def c08_new_regions(spark, sf_dir):
    d = detections(spark, sf_dir)
    known = d.where("det_id % 3 = 0").withColumn("x1", F.col("x1") + 40).withColumn("x2", F.col("x2") + 40)
    return match.set_anti_overlap(d.where("det_id % 3 = 1"), known, ["job_id", "frame_index"], 0.08).select("det_id")


@query(DET.replace("with ", "with recursive ", 1) + f""", k as (select * from v_detections where det_id % 9 = 0), nk as (select job_id, frame_index, count(*) k from k group by 1, 2),
n as (select *, row_number() over (partition by job_id, frame_index order by det_id) rn from v_detections where det_id % 9 <> 0),
bad as (select distinct a.det_id from n a join k b on a.job_id = b.job_id and a.frame_index = b.frame_index and {_IOU} > 0 and ({_IOU})::double / ({_AREAS} - {_IOU}) > 0.08),
clash as (select a.det_id, list(b.rn) rns from n a join n b on a.job_id = b.job_id and a.frame_index = b.frame_index and b.rn < a.rn and {_IOU} > 0 and ({_IOU})::double / ({_AREAS} - {_IOU}) > 0.08 group by 1),
m as (select n.job_id, n.frame_index, n.rn, n.det_id, coalesce(nk.k, 0) k, n.det_id in (select det_id from bad) b, coalesce(c.rns, []) c from n left join nk using (job_id, frame_index) left join clash c using (det_id)),
w as (select job_id, frame_index, rn, case when b or k >= 4 then []::bigint[] else [rn] end kept from m where rn = 1
  union all select m.job_id, m.frame_index, m.rn, case when m.b or m.k + len(w.kept) >= 4 or list_has_any(w.kept, m.c) then w.kept else list_append(w.kept, m.rn) end from w join m on m.job_id = w.job_id and m.frame_index = w.frame_index and m.rn = w.rn + 1),
z as (select job_id, frame_index, max_by(kept, rn) kept from w group by 1, 2)
select job_id, frame_index, det_id, true known from k union all select m.job_id, m.frame_index, m.det_id, false from m join z using (job_id, frame_index) where list_contains(z.kept, m.rn)""")
def c08_accepted_regions(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("known", F.col("det_id") % 9 == 0)
    return tracking.accept_new_regions(d, ["job_id", "frame_index"], ["det_id"]).select("job_id", "frame_index", "det_id", "known")


def _greedy(test: str, limit: str = "") -> str:
    return DET + f""", r as (select *, row_number() over (partition by job_id, frame_index order by confidence desc, det_id) rn from v_detections),
c as (select a.job_id, a.frame_index, a.rn, list(b.rn) bad from r a join r b on a.job_id = b.job_id and a.frame_index = b.frame_index and b.rn < a.rn and {test} group by 1, 2, 3),
m as (select r.job_id, r.frame_index, r.rn, r.det_id, coalesce(c.bad, []) bad from r left join c using (job_id, frame_index, rn)),
w as (select job_id, frame_index, rn, [rn] kept from m where rn = 1 union all
  select m.job_id, m.frame_index, m.rn, case when list_has_any(w.kept, m.bad) {limit} then w.kept else list_append(w.kept, m.rn) end from w join m on m.job_id = w.job_id and m.frame_index = w.frame_index and m.rn = w.rn + 1),
z as (select job_id, frame_index, max_by(kept, rn) kept from w group by 1, 2)
select m.det_id from m join z using (job_id, frame_index) where list_contains(z.kept, m.rn)""".replace("with ", "with recursive ", 1)


@query(_greedy(f"{_IOU} >= 0.72 * ({_AREAS} - {_IOU}) and {_AREAS} - {_IOU} > 0").replace("with v_det", "with recursive v_det", 1))
def c09_greedy_dedup(spark, sf_dir):
    return match.greedy_keep(detections(spark, sf_dir), ["job_id", "frame_index"], [-F.col("confidence"), F.col("det_id")], 0.72).select("det_id")


@query(_greedy(f"{_IOU} > 0.55 * ({_AREAS} - {_IOU}) and {_AREAS} - {_IOU} > 0", "or len(w.kept) >= 4").replace("with v_det", "with recursive v_det", 1))
def c10_nms(spark, sf_dir):
    return match.greedy_keep(detections(spark, sf_dir), ["job_id", "frame_index"], [-F.col("confidence"), F.col("det_id")], 0.55, strict=True, limit=4).select("det_id")


@query()
def c11_assignment(spark, sf_dir):
    d = detections(spark, sf_dir).select("job_id", "frame_index", "det_id", "x1", "y1", "x2", "y2")
    now = d.select("job_id", "frame_index", F.col("det_id").alias("left_id"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    nxt = d.select("job_id", (F.col("frame_index") - 1).alias("frame_index"), F.col("det_id").alias("right_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    costs = now.join(nxt, ["job_id", "frame_index"]).select("job_id", "frame_index", "left_id", "right_id", (1 - g.iou(g.box("a_"), g.box("b_"))).alias("cost"))
    return tracking.assign_groups(costs, ["job_id", "frame_index"], "left_id", "right_id")


_CODES = "l as (select c_nationkey k, c_custkey id, (c_custkey * 2654435761) % 4294967296 code from customer), r as (select s_nationkey k, s_suppkey id, (s_suppkey * 40503 * 65537) % 4294967296 code from supplier)"


@query("with " + _CODES + """, d as (select l.k, l.id left_id, r.id right_id, bit_count(xor(l.code, r.code)) d from l join r using (k)), w as (select *, row_number() over (partition by k, left_id order by d, right_id) rn, lead(d) over (partition by k, left_id order by d, right_id) s from d),
m as (select *, count(*) over (partition by k) n from w where rn = 1 and d < 0.75 * s) select k, left_id, right_id, cast(d as integer) d from m where n >= 8""")
def c13_ratio_matches(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 2654435761) % 4294967296).alias("code"))
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 40503 * 65537) % 4294967296).alias("code"))
    return match.ratio_matches(a, b, ["k"])


@query(DET + f""", b as (select job_id, frame_index, x1 + 30 x1, y1 + 4 y1, x2 + 30 x2, y2 + 4 y2 from v_detections where det_id % 5 = 0), j as (select a.job_id, a.frame_index, a.confidence, {_IOU} i, {_AREAS} s from v_detections a left join b on a.job_id = b.job_id and a.frame_index = b.frame_index)
select job_id, frame_index, round(coalesce(max(case when i > 0.01 * (s - i) then confidence * least(1, 4 * (i / (s - i))) end), 0), 9) score from j group by 1, 2""")
def c16_overlap_score(spark, sf_dir):
    d = detections(spark, sf_dir)
    m = d.where("det_id % 5 = 0").select("job_id", "frame_index", (F.col("x1") + 30).alias("x1"), (F.col("y1") + 4).alias("y1"), (F.col("x2") + 30).alias("x2"), (F.col("y2") + 4).alias("y2"))
    return match.overlap_score(d, m, ["job_id", "frame_index"], "det_id").withColumn("score", F.round("score", 9))


@query(DET + """, m as (select job_id, x1 // 400 slot, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2, count(distinct frame_index) seen, avg(confidence) conf from v_detections group by 1, 2), t as (select job_id, count(distinct frame_index) total from v_detections group by 1),
p as (select m.job_id, slot, greatest(0, x1 - 27) x1, greatest(0, y1 - 27) y1, least(1920, x2 + 27) x2, least(1080, y2 + 27) y2, seen, conf, total from m join t using (job_id))
select job_id, slot, x1, y1, x2, y2, round(0.42 * seen / greatest(total, 1) + 0.28 * conf + 0.18 * greatest(0, ((y1 + y2) / 2.0::double / 1080 - 0.45) / 0.55) + 0.12 * greatest(0, 1 - abs((x1 + x2) / 2.0::double / 1920 - 0.5) * 1.5) - 0.12 * least(1, (x2 - x1) * (y2 - y1) / (1920 * 1080 * 0.25)), 9) score from p""")
def d03_roi_score(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("slot", F.expr("x1 div 400"))
    out = aggregate.roi_scores(d, ["job_id"], "slot", 1920, 1080)
    return out.withColumn("score", F.round("score", 9))


#: Tracks: slots of detections of one job and stretch of frames.
_TR = DET + """, t as (select *, job_id * 100 + (frame_index // 40) * 10 + x1 // 400 tr, frame_index * 500000 pts_us, (x1 + x2) / 2.0::double / 1920 cx, (y1 + y2) / 2.0::double / 1080 cy, x2 - x1 w, y2 - y1 h from v_detections),
s as (select *, sqrt(power(cx - lag(cx) over o, 2) + power(cy - lag(cy) over o, 2)) st from t window o as (partition by tr order by frame_index, pts_us, x1, y1, x2, y2)),
a as (select tr, avg(confidence) conf, round(sqrt(power(stddev_pop(cx), 2) + power(stddev_pop(cy), 2)), 12) sd, (max(pts_us) - min(pts_us)) / 1e6 dur, avg(cx) mx, avg(cy) my, coalesce(avg(st), 0) mo, count(distinct frame_index) fr, avg(w * h) / (1920 * 1080) ar,
  median(w) mw, median(h) mh, stddev_pop(w * h) asd, avg(w * h) am, count(*) n, sqrt(power((max_by(cx, (frame_index, pts_us, x1, y1, x2, y2)) - min_by(cx, (frame_index, pts_us, x1, y1, x2, y2))) * 1920, 2) + power((max_by(cy, (frame_index, pts_us, x1, y1, x2, y2)) - min_by(cy, (frame_index, pts_us, x1, y1, x2, y2))) * 1080, 2)) mv from s group by tr),
f as (select *, greatest(0, least(1, 1 - sd * 7)) stability, case when dur <= 12 then exp(-power((dur - 2.7) / 3.5, 2)) else 0.15 end cadence,
  greatest(greatest(0, least(1, (my - 0.52) / 0.35)) * greatest(0, least(1, 1 - abs(mx - 0.5) * 2.3)), greatest(0, least(1, (0.25 - my) / 0.25)) * greatest(0, least(1, 1 - abs(mx - 0.5) * 2.3)) * 0.72) layout,
  case when (mx < 0.2 or mx > 0.8) and (my < 0.25 or my > 0.75) and ar < 0.012 then 1.0 else 0.0 end tiny_corner from a),
k as (select *, greatest(0, least(1, stability + (0.04 - mo) * 4)) decoupling, greatest(0, least(1, (fr / 40.0::double - 0.55) / 0.45)) * (0.5 + 0.5 * tiny_corner) logo, greatest(0, least(1, mo * 18)) * (1 - stability) coupling, greatest(0, least(1, (dur - 8) / 15)) * stability unchanged from f),
z as (select *, round(greatest(0, least(1, 0.18 * conf + 0.18 * stability + 0.16 * cadence + 0.12 * layout + 0.10 * 0.5 + 0.16 * decoupling - 0.22 * logo - 0.28 * coupling - 0.12 * tiny_corner - 0.15 * unchanged)), 9) score from k)
"""


def tracks(spark, sf_dir):
    c = F.col
    d = detections(spark, sf_dir).withColumn("tr", c("job_id") * 100 + F.expr("frame_index div 40") * 10 + F.expr("x1 div 400")).withColumn("pts_us", c("frame_index") * 500_000)
    return aggregate.track_features(d, ["tr"], 1920, 1080, F.lit(40), F.lit(0.5))


@query(_TR + "select tr, round(stability, 6) stability, round(cadence, 6) cadence, round(layout, 6) layout, cast(tiny_corner as double) tiny_corner, round(decoupling, 6) decoupling, round(logo, 6) logo, round(coupling, 6) coupling, round(unchanged, 6) unchanged from k")
def d14_track_features(spark, sf_dir):
    r = lambda n: F.round(n, 6).alias(n)
    return tracks(spark, sf_dir).select("tr", r("stability"), r("cadence"), r("layout"), "tiny_corner", r("decoupling"), r("logo"), r("coupling"), r("unchanged"))


@query(_TR + "select tr, round(score, 6) score, case when score >= 0.62 then 'subtitle' when score >= 0.45 then 'uncertain' when logo > 0.45 or tiny_corner > 0.5 then 'logo' else 'scene_text' end as class, mh > mw * 1.25 is_vertical, mv > 28.8 is_moving, n > 4 and asd / greatest(am, 1) > 0.18 and layout > 0.45 is_karaoke from z")
def d15_track_class(spark, sf_dir):
    out = aggregate.classify_tracks(tracks(spark, sf_dir), 1920)
    return out.select("tr", F.round("score", 6).alias("score"), "class", "is_vertical", "is_moving", "is_karaoke")


@query(DET + """, s as (select job_id, x1 // 400 slot, frame_index, min(x1)::double x, min(confidence) c from v_detections where frame_index % 5 <> 2 and det_id % 3 <> 0 group by 1, 2, 3),
l as (select *, lead(frame_index) over w nf, lead(x) over w nx, lead(c) over w nc from s window w as (partition by job_id, slot order by frame_index))
select job_id, slot, frame_index, round(c, 9) confidence, round(x, 6) x, false propagated from s union all
select job_id, slot, f frame_index, round(0.72 * least(c, nc), 9), round(x + (nx - x) * ((f - frame_index) / (nf - frame_index)), 6), true from (select *, unnest(range(frame_index + 1, nf)) f from l where nf - frame_index > 1 and nf - frame_index <= 9)""")
def e11_gap_fill(spark, sf_dir):
    s = detections(spark, sf_dir).where("frame_index % 5 <> 2 and det_id % 3 <> 0").groupBy("job_id", F.expr("x1 div 400").alias("slot"), "frame_index").agg(F.min("x1").alias("x"), F.min("confidence").alias("confidence"))
    return window.gap_fill(s, ["job_id", "slot"], "frame_index", ["x"]).withColumn("confidence", F.round("confidence", 9)).withColumn("x", F.round("x", 6))


def tracked_shots(orders, *more: str):
    """Detections as the tracker takes them, in shots of 40 frames, of lines of several looks and slants."""
    look = [F.expr(f"cast(40 + 60 * (x1 div 400) + 5 * ((det_id + {i}) % 3) as double)").alias(f"look{i}") for i in range(3)]
    angle = F.expr("cast(10 * (y1 div 5 % 3) + det_id % 4 as double)").alias("angle")
    return detections_of(orders, *more).select("job_id", F.expr("frame_index div 40").cast("bigint").alias("shot_id"), "frame_index", "det_id", "x1", "y1", "x2", "y2", "confidence", angle, *look, *more)


@query()
def e12_tracker(spark, sf_dir):
    return tracking.track(tracked_shots(spark.read.parquet(f"{sf_dir}/orders.parquet")), ["job_id", "shot_id"]).select("job_id", "shot_id", "det_id", "track_id")


@query()
def e14_clusters(spark, sf_dir):
    shots = detections(spark, sf_dir).withColumn("shot_id", F.expr("frame_index div 40"))
    out = tracking.region_clusters(shots, ["job_id", "shot_id"], ["frame_index", "det_id"])
    return out.select("det_id", "cluster")


@query()
def f05_diverse_references(spark, sf_dir):
    f = detections(spark, sf_dir).groupBy("job_id", "frame_index").agg(F.avg("confidence").alias("s"))
    pairs = match.band_self_join(f.withColumn("at", F.col("frame_index")), ["job_id"], "at", "frame_index", 20).select("job_id", F.col("frame_index").alias("target"), F.col("ref_frame_index").alias("ref"))
    near = pairs.join(f.select("job_id", F.col("frame_index").alias("ref"), "s"), ["job_id", "ref"]).select("job_id", "target", "ref", (F.col("s") * F.exp(-F.abs(F.col("target") - F.col("ref")) / 8.5)).alias("score"))
    return tracking.diverse_references(near, ["job_id"])


@query(DET + "select job_id, frame_index, list(det_id order by confidence desc, det_id)[1] best, cast(count(*) as bigint) n from v_detections group by 1, 2")
def f07_best_candidate_f08_order(spark, sf_dir):
    first = F.min_by("det_id", F.struct((-F.col("confidence")).alias("c"), "det_id"))
    return detections(spark, sf_dir).groupBy("job_id", "frame_index").agg(first.alias("best"), F.count("*").alias("n"))


@query(DET + """, b as (select job_id, frame_index, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from v_detections group by 1, 2), r as (select *, row_number() over (partition by job_id order by frame_index) - 1 rn, count(*) over (partition by job_id) n from b),
s as (select distinct r.* from r, (select unnest(range(0, 9)) i) where n <= 9 or rn = round_even(i * (n - 1) / 8.0::double, 0))
select job_id, cast(greatest(0, min(x1) - 27) as bigint) x1, cast(greatest(0, min(y1) - 27) as bigint) y1, cast(least(1920, max(x2) + 27) as bigint) x2, cast(least(1080, max(y2) + 27) as bigint) y2 from s group by job_id""")
def d34_mask_roi(spark, sf_dir):
    boxes = aggregate.box_union(detections(spark, sf_dir), ["job_id", "frame_index"])
    u = aggregate.box_union(window.even_sample(boxes, ["job_id"], ["frame_index"], 9), ["job_id"])
    return u.select("job_id", *[c.cast("bigint").alias(n) for c, n in zip(g.expand(g.box(), 27, 1920, 1080), ("x1", "y1", "x2", "y2"), strict=True)])


@query(DET + "select f.job_id, f.frame_index, r.id roi_id, r.x1, r.y1, r.x2, r.y2 from (select distinct job_id, frame_index from v_detections) f, (select 1 id, 0 x1, 700 y1, 1920 x2, 1080 y2 union all select 2, 100, 0, 400, 90) r")
def a26_roi_masks(spark, sf_dir):
    f = detections(spark, sf_dir).select("job_id", "frame_index").distinct()
    rois = spark.createDataFrame([(1, -5, 700, 2500, 1200), (2, 100, 0, 400, 90), (3, 2000, 0, 2100, 50)], "roi_id int, x1 int, y1 int, x2 int, y2 int")
    return masks.rectangles(f, rois, 1920, 1080)
