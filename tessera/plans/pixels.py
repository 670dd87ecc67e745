"""Queries over tall pixels (D02, D05-D12, D16-D24, D29, D31-D33, E17, H17, I02, I12, I13, I18) and dense kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import aggregate, kernels, masks
from tessera.plans.registry import query
from tessera.plans.views import duck, view

PX = duck("v_pixels")
PIXEL = ["shot_id", "y", "x"]


def pixels(spark, sf_dir):
    return view(spark, sf_dir, "v_pixels")


@query(PX + "select frame_index, min(x) x1, min(y) y1, max(x) + 1 x2, max(y) + 1 y2 from v_pixels where masked = 1 group by 1")
def d02_mask_box(spark, sf_dir):
    return aggregate.mask_box(pixels(spark, sf_dir), ["frame_index"])


_W = "w as (select *, (1 + (frame_index * 7 + x + y) % 10) / 10.0::double wt from v_pixels)"


def weighed(spark, sf_dir):
    c = F.col
    return pixels(spark, sf_dir).withColumn("wt", (1 + (c("frame_index") * 7 + c("x") + c("y")) % 10) / 10.0)


@query(PX + ",\n" + _W + """, r as (select *, sum(cast(wt * 10 as integer)) over (partition by shot_id, y, x order by "value", frame_index) run, sum(cast(wt * 10 as integer)) over (partition by shot_id, y, x) al from w)
select shot_id, y, x, min("value") filter (run * 2 >= al) "value" from r group by 1, 2, 3""")
def d16_weighted_median(spark, sf_dir):
    tenths = weighed(spark, sf_dir).withColumn("wt", F.bround(F.col("wt") * 10))
    return aggregate.weighted_median(tenths, PIXEL, "value", "wt", "frame_index", F.lit(0).cast("bigint"))


@query(PX + ",\n" + _W + """, r as (select *, row_number() over (partition by shot_id, y, x order by "value", frame_index) - 1 rn, count(*) over (partition by shot_id, y, x) n from w),
k as (select *, least(floor(n * 0.2), (n - 1) // 2) t from r) select shot_id, y, x, cast(floor(round(sum(wt * "value") / sum(wt), 9)) as bigint) "value" from k where rn >= t and rn < n - t group by 1, 2, 3""")
def d17_trimmed_mean(spark, sf_dir):
    return aggregate.trimmed_mean(weighed(spark, sf_dir), PIXEL, "value", "wt", "value", "frame_index", F.lit(0).cast("bigint"))


@query(PX + ",\n" + _W + """ select shot_id, y, x, arg_max("value", wt * 1000 - frame_index / 1000000.0::double) "value" from w group by 1, 2, 3""")
def d18_best_reference(spark, sf_dir):
    return aggregate.best_reference(weighed(spark, sf_dir), PIXEL, "value", "wt", "frame_index", F.lit(0).cast("bigint"))


_LOW = "l as (select *, wt * 0.3 lw from w)"


@query(PX + ",\n" + _W + ",\n" + _LOW + """ select shot_id, y, x, round(1 - product(1 - least(greatest(lw - 0.05, 0), 0.98)), 9) confidence from l group by 1, 2, 3""")
def d19_noisy_or(spark, sf_dir):
    return weighed(spark, sf_dir).groupBy(*PIXEL).agg(F.round(aggregate.noisy_or(F.col("wt") * 0.3 - 0.05), 9).alias("confidence"))


@query(PX + ",\n" + _W + """, a as (select shot_id, y, x, count(*) filter (lw > 0.16) valid, max(lw) best, 1 - product(1 - least(greatest(lw, 0), 0.98)) conf from (select *, wt * 0.21 lw from w) group by 1, 2, 3)
select shot_id, y, x, cast(valid as bigint) valid, round(best, 9) best, round(conf, 9) confidence, round(least(1, valid / 5.0::double), 9) coverage, (valid >= 3 and conf >= 0.42) or (valid >= 1 and best >= 0.88 and conf >= 0.82) trusted from a""")
def d20_trust(spark, sf_dir):
    few = weighed(spark, sf_dir).withColumn("lw", F.col("wt") * 0.21)
    out = aggregate.trust(few, PIXEL, "lw")
    r = lambda n: F.round(n, 9).alias(n)
    return out.select(*PIXEL, "valid", r("best"), r("confidence"), r("coverage"), "trusted")


@query(PX + ",\n" + _W + """, m as (select shot_id, y, x, frame_index % 25 ref, wt * 0.5 lw from w),
r as (select *, count(*) filter (lw > 0.16) over p v, 1 - exp(sum(ln(1 - least(greatest(lw, 0), 0.98))) over p) cf from m window p as (partition by shot_id, y, x order by ref)),
a as (select shot_id, ref, round(avg(case when v >= 3 then 1.0 else 0 end), 9) sh, round(avg(cf), 9) mc from r group by 1, 2)
select shot_id, cast(coalesce(min(ref) filter (sh >= 0.965 and mc >= 0.84), max(ref)) as bigint) used from a group by 1""")
def d29_early_stop(spark, sf_dir):
    m = weighed(spark, sf_dir).withColumn("ref", F.col("frame_index") % 25).withColumn("lw", F.col("wt") * 0.5)
    return aggregate.early_stop(m, ["shot_id"], ["y", "x"], "lw", "ref")


_CHANGED = """c as (select shot_id, frame_index, masked, "value" before, case when masked = 1 then 255 - "value" when (frame_index + x) % 97 = 0 then "value" + 3 else "value" + (x % 2) end after from v_pixels)"""


def changed(spark, sf_dir):
    c = F.col
    after = F.when(c("masked") == 1, 255 - c("value")).when((c("frame_index") + c("x")) % 97 == 0, c("value") + 3).otherwise(c("value") + c("x") % 2)
    return pixels(spark, sf_dir).select("shot_id", "frame_index", "y", "x", "masked", c("value").alias("before"), after.alias("after"))


@query(PX + ",\n" + _CHANGED + """, p as (select shot_id, frame_index, max(abs(before - after)) m, avg(case when abs(before - after) > 1 then 1.0 else 0 end) s from c where masked = 0 group by 1, 2)
select shot_id, max(m) max_error, round(avg(s), 9) changed_share from p group by 1""")
def d09_preservation(spark, sf_dir):
    return aggregate.preservation(changed(spark, sf_dir), ["shot_id", "frame_index"], ["shot_id"]).withColumn("changed_share", F.round("changed_share", 9))


@query(PX + ",\n" + _CHANGED + " select shot_id, bool_or(before <> after) modified from c group by 1")
def h17_modified(spark, sf_dir):
    return changed(spark, sf_dir).groupBy("shot_id").agg(F.bool_or(F.col("before") != F.col("after")).alias("modified"))


_NB = """n as (select *, lag("value") over r l, lead("value") over r g, lag("value") over c u, lead("value") over c d, max(masked) over (partition by frame_index, x order by y range between 2 preceding and 2 following) mv from v_pixels
  window r as (partition by frame_index, y order by x), c as (partition by frame_index, x order by y)),
q as (select *, abs(coalesce(l, g) + coalesce(g, l) + coalesce(u, d) + coalesce(d, u) - 4 * "value") lap, max(mv) over (partition by frame_index, y order by x range between 2 preceding and 2 following) > 0 and masked = 0 ring from n)"""


@query(PX + ",\n" + _NB + """, p as (select shot_id, frame_index, avg(lap) filter (masked > 0) i, avg(lap) filter (ring) o from q group by 1, 2) select shot_id, round(median(i / greatest(o, 0.001)), 6) sharpness from p where i is not null and o is not null group by 1""")
def d10_sharpness(spark, sf_dir):
    return aggregate.sharpness(pixels(spark, sf_dir), ["frame_index"], ["shot_id"], 2).withColumn("sharpness", F.round("sharpness", 6))


def _change(inside: str, q: float, gain: float) -> str:
    return PX + f""", d as (select shot_id, frame_index, masked, abs("value" - lag("value") over w) / 255.0::double d, frame_index - lag(frame_index) over w g from v_pixels window w as (partition by shot_id, y, x order by frame_index)),
p as (select shot_id, frame_index, quantile_cont(d, {q}) p from d where g = 1 {inside} group by 1, 2) select shot_id, round(greatest(0, least(1, {gain} * avg(p))), 6) score from p group by 1"""


@query(_change("and masked > 0", 0.85, 2.5))
def d08_crossing(spark, sf_dir):
    return aggregate.motion_share(pixels(spark, sf_dir), ["shot_id"], "frame_index", 0.85, 2.5, True).withColumn("score", F.round("score", 6))


@query(_change("", 0.90, 2.2))
def d07_flicker(spark, sf_dir):
    return aggregate.motion_share(pixels(spark, sf_dir), ["shot_id"], "frame_index", 0.90, 2.2, False).withColumn("score", F.round("score", 6))


@query(PX + """, s as (select shot_id, frame_index % 2 side, cast(floor("value" * 32 / 256) as bigint) b, count(*) n from v_pixels group by 1, 2, 3), p as (select *, n / sum(n) over (partition by shot_id, side) p from s),
w as (select shot_id, b, coalesce(sum(p) filter (side = 0), 0) a, coalesce(sum(p) filter (side = 1), 0) c from p group by 1, 2) select shot_id, round(sqrt(greatest(0, 1 - sum(sqrt(a * c)))), 6) distance from w group by 1""")
def d23_histogram_distance(spark, sf_dir):
    two = pixels(spark, sf_dir).withColumn("side", F.col("frame_index") % 2)
    return aggregate.histogram_distance(two, ["shot_id"], "side").withColumn("distance", F.round("distance", 6))


_XY = """xy as (select a.shot_id, a."value"::double x_value, least(255, greatest(0, floor(a."value" * 0.9 + 12 + (b."value" % 7))))::double y_value from v_pixels a join v_pixels b on b.frame_index = a.frame_index + 1 and a.shot_id = b.shot_id and a.y = b.y and a.x = b.x)"""


def neighbours(spark, sf_dir):
    p = pixels(spark, sf_dir)
    b = p.select("shot_id", "y", "x", (F.col("frame_index") - 1).alias("frame_index"), F.col("value").alias("other"))
    return p.join(b, ["shot_id", "frame_index", "y", "x"])


@query(PX + ",\n" + _XY + """, u as (select *, y_value - x_value d from xy where x_value > 5 and x_value < 250 and y_value > 5 and y_value < 250), l as (select shot_id, quantile_cont(d, 0.08) lo, quantile_cont(d, 0.92) hi, count(*) n from u group by 1),
k as (select u.* from u join l using (shot_id) where d >= lo - 1e-9 and d <= hi + 1e-9 and n >= 64), f as (select shot_id, greatest(0.72, least(1.38, coalesce(regr_slope(y_value, x_value), 1))) gain, greatest(-48, least(48, coalesce(regr_intercept(y_value, x_value), median(d)))) off_ from k group by 1)
select s.shot_id, round(coalesce(f.gain, 1), 5) gain, round(coalesce(f.off_, 0), 5) "offset" from (select distinct shot_id from xy) s left join f using (shot_id)""")
def d24_affine_fit(spark, sf_dir):
    xy = neighbours(spark, sf_dir).select("shot_id", F.col("value").cast("double").alias("x_value"), g.clip(F.floor(F.col("value") * 0.9 + 12 + F.col("other") % 7), 0, 255).cast("double").alias("y_value"))
    out = aggregate.affine_fit(xy, ["shot_id"])
    return out.select("shot_id", F.round("gain", 5).alias("gain"), F.round("offset", 5).alias("offset"))


@query(PX + """, j as (select a.shot_id, a.frame_index, abs(a."value" - b."value") / 255.0::double d from v_pixels a join v_pixels b on b.frame_index = a.frame_index + 1 and a.shot_id = b.shot_id and a.y = b.y and a.x = b.x)
select shot_id, frame_index, round(0.45 * median(d) + 0.35 * quantile_cont(d, 0.75) + 0.20 * avg(d), 6) error from j group by 1, 2""")
def d31_registration_error(spark, sf_dir):
    pairs = neighbours(spark, sf_dir).withColumnRenamed("value", "a").withColumnRenamed("other", "b")
    return aggregate.registration_error(pairs, ["shot_id", "frame_index"]).withColumn("error", F.round("error", 6))


@query(PX + """, a as (select frame_index, stddev_pop("value") filter (masked = 1) s, avg("value") filter (masked = 1) m, avg("value") p from v_pixels group by 1) select frame_index, round(m, 6) mean, round(greatest(0, least(1, (s + abs(m - p)) / 96)), 6) contrast from a""")
def d32_appearance_d33_contrast(spark, sf_dir):
    on = F.when(F.col("masked") == 1, F.col("value"))
    a = pixels(spark, sf_dir).groupBy("frame_index").agg(F.stddev_pop(on).alias("s"), F.avg(on).alias("m"), F.avg("value").alias("p"))
    return a.select("frame_index", F.round("m", 6).alias("mean"), F.round(aggregate.local_contrast(F.col("s"), F.col("m"), F.col("p")), 6).alias("contrast"))


@query(PX + "select shot_id, frame_index, y, x, max(masked) over (partition by shot_id, y, x order by frame_index range between 1 preceding and 1 following) wide from v_pixels")
def e17_temporal_union(spark, sf_dir):
    from tessera.operators.window import temporal_union

    return temporal_union(pixels(spark, sf_dir), PIXEL, "frame_index", "masked", 1, "wide").select("shot_id", "frame_index", "y", "x", "wide")


@query(PX + """ select distinct frame_index, y, x from (select frame_index, y, unnest(range(greatest(0, x - 1), least(7, x + 1) + 1)) x from (select frame_index, unnest(range(greatest(0, y - 1), least(7, y + 1) + 1)) y, x from v_pixels where masked = 1 and (frame_index + x) % 5 = 0))""")
def i02_dilation(spark, sf_dir):
    on = pixels(spark, sf_dir).where("masked = 1 and (frame_index + x) % 5 = 0").select("frame_index", "y", "x")
    return masks.dilate_square(on, ["frame_index"], 1, 8, 8)


@query(PX + """ select p.frame_index, cast(ty as bigint) y, cast(tx as bigint) x, p.masked from v_pixels p join (select unnest(range(12)) ty) a on p.y = ty * 8 // 12 join (select unnest(range(20)) tx) b on p.x = tx * 8 // 20""")
def i18_resize_nearest(spark, sf_dir):
    return masks.resize_nearest(pixels(spark, sf_dir), ["frame_index"], "masked", (8, 8), (12, 20)).select("frame_index", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "masked")


@query(PX + """ select frame_index, y, x, cast(greatest(0, least(255, floor("value" * 1.125 - 7.5))) as bigint) adjusted, cast(case when masked = 0 then "value" else floor("value" * 0.75 + (255 - "value") * 0.25) end as bigint) mixed from v_pixels""")
def i12_exposure_i13_composite(spark, sf_dir):
    v = F.col("value")
    mixed = F.when(F.col("masked") == 0, v).otherwise(F.floor(v * 0.75 + (255 - v) * 0.25))
    return pixels(spark, sf_dir).select("frame_index", "y", "x", F.floor(g.clip(v * 1.125 - 7.5, 0, 255)).alias("adjusted"), mixed.cast("bigint").alias("mixed"))


@query(PX + """, d as (select shot_id, frame_index, masked, "value", lag("value") over (partition by shot_id, y, x order by frame_index) b from v_pixels)
select shot_id, cast(count(distinct frame_index) as bigint) frames, round(avg(masked), 6) mask_ratio, round(avg("value") filter (masked = 1), 6) inside_mean, cast(count(*) filter (masked = 1 and "value" > 150) as bigint) residual_px, round(avg(abs("value" - b)) / 255, 6) motion from d group by 1""")
def d05_segment_features(spark, sf_dir):
    from pyspark.sql import Window

    d = pixels(spark, sf_dir).withColumn("b", F.lag("value").over(Window.partitionBy(*PIXEL).orderBy("frame_index")))
    on = F.col("masked") == 1
    return d.groupBy("shot_id").agg(F.count_distinct("frame_index").alias("frames"), F.round(F.avg("masked"), 6).alias("mask_ratio"), F.round(F.avg(F.when(on, F.col("value"))), 6).alias("inside_mean"), F.count_if(on & (F.col("value") > 150)).alias("residual_px"), F.round(F.avg(F.abs(F.col("value") - F.col("b"))) / 255, 6).alias("motion"))


def _planes(spark, sf_dir):
    packed = F.array_sort(F.collect_list(F.struct("y", "x", "value", "masked")))  # 64 pixels of a frame
    hexed = lambda f: F.unhex(F.array_join(F.transform("p", lambda s: F.lpad(F.hex(f(s)), 2, "0")), ""))
    rows = pixels(spark, sf_dir).groupBy("frame_index").agg(packed.alias("p"))
    return rows.select("frame_index", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), hexed(lambda s: s["value"]).alias("pixels"), hexed(lambda s: s["masked"] * 255).alias("mask"))


_PARTS = PX.replace("with ", "with recursive ", 1) + """, c as (select frame_index f, y, x, y * 8 + x i from v_pixels where masked = 1),
n as (select a.f, a.i, b.i j from c a join c b on a.f = b.f and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
r as (select f, i root, i from c union select r.f, r.root, n.j from r join n on n.f = r.f and n.i = r.i),
p as (select f, i, min(root) part from r group by 1, 2), q as (select f, part, count(*) n from p group by 1, 2), fr as (select distinct frame_index f from v_pixels)
"""


@query(_PARTS + "select fr.f frame_index, cast(coalesce(max(q.n), 0) as bigint) largest, count(q.n) parts from fr left join q on q.f = fr.f group by 1")
def d21_largest_component(spark, sf_dir):
    def measure(batches):
        for batch in batches:
            masks = [np.frombuffer(m, np.uint8).reshape(h, w) for h, w, m in zip(batch.height, batch.width, batch["mask"], strict=True)]
            yield pd.DataFrame({"frame_index": batch.frame_index, "largest": [kernels.largest_component(m) for m in masks], "parts": [len(kernels.components(m)[1]) for m in masks]})

    return _planes(spark, sf_dir).mapInPandas(measure, "frame_index long, largest long, parts long")


@query(_PARTS + "select p.f frame_index, cast(p.i // 8 as bigint) y, cast(p.i % 8 as bigint) x from p join q using (f, part) where q.n >= 4")
def d22_small_components(spark, sf_dir):
    kept = kernels.per_frame(_planes(spark, sf_dir), lambda image, mask: kernels.drop_small(mask, 4))
    at = kept.select("frame_index", F.hex("result").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where(F.substring("h", 2 * F.col("i") + 1, F.lit(2)) != "00")
    return at.select("frame_index", F.expr("cast(i div 8 as bigint)").alias("y"), F.expr("cast(i % 8 as bigint)").alias("x"))


@query(PX + """, l as (select frame_index, "value" / 255.0::double v from v_pixels where y between 2 and 6 and x between 1 and 6), f as (select frame_index, case when v <= 0.04045 then v / 12.92 else pow((v + 0.055) / 1.055, 2.4::double) end v from l)
select frame_index, round(avg((116 * case when v > 0.008856 then cbrt(v) else 7.787 * v + 16 / 116.0::double end - 16) * 2.55), 4) l, 128.0::double a, 128.0::double b from f group by 1""")
def d32_patch_look(spark, sf_dir):
    """The mean Lab of a patch by the operator itself; a gray patch has no colour."""

    def look(batches):
        for batch in batches:
            rows = [kernels.appearance(np.frombuffer(p, np.uint8).reshape(h, w), (1, 2, 7, 7)) for h, w, p in zip(batch.height, batch.width, batch.pixels, strict=True)]
            out = pd.DataFrame(np.round(np.array(rows).reshape(-1, 3), 4), columns=["l", "a", "b"])
            out.insert(0, "frame_index", batch.frame_index.to_numpy())
            yield out

    return _planes(spark, sf_dir).mapInPandas(look, "frame_index long, l double, a double, b double")


@query(PX + " select frame_index, count(*) filter (masked = 0) outside, 0::bigint changed_outside, true same_again from v_pixels group by 1")
def i13_composite_exact(spark, sf_dir):
    """The composite of a darker fill: no pixel outside the mask changes, and a seed gives the same again."""

    def compose(batches):
        for batch in batches:
            rows = []
            for f, h, w, p, m in zip(batch.frame_index, batch.height, batch.width, batch.pixels, batch["mask"], strict=True):
                image, mask = np.frombuffer(p, np.uint8).reshape(h, w), np.frombuffer(m, np.uint8).reshape(h, w)
                color = np.repeat(image[..., None], 3, 2)
                out, again = (kernels.composite_exact(color, color // 2, mask, 2, seed=int(f)) for _ in range(2))
                rows.append((f, int((mask == 0).sum()), int((out != color).any(axis=2)[mask == 0].sum()), bool((out == again).all())))
            yield pd.DataFrame(rows, columns=["frame_index", "outside", "changed_outside", "same_again"])

    return _planes(spark, sf_dir).mapInPandas(compose, "frame_index long, outside long, changed_outside long, same_again boolean")


@query()
def i14_diffusion_fill(spark, sf_dir):
    return kernels.per_frame(_planes(spark, sf_dir), lambda image, mask: kernels.diffuse(image, mask)).select("frame_index", F.hex("result").alias("repaired"))


@query()
def i03_i04_soft_alpha(spark, sf_dir):
    return kernels.per_frame(_planes(spark, sf_dir), lambda image, mask: (kernels.soft_alpha(kernels.fill_holes(mask), 2) * 255).round()).select("frame_index", F.hex("result").alias("alpha"))
