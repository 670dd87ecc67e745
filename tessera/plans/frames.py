"""Queries over frames in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import match, tracking, window
from tessera.plans.registry import query
from tessera.plans.views import duck, view

FR = duck("v_frames")
MIN = 60_000_000
#: A shot is a day and a half of a job's events.
SHOT = 1440 * 90 * MIN // 60
SHOTS = f"""shots as (select job_id, pts_us // {SHOT} shot_id, min(pts_us) start_pts_us, max(pts_us) + 1 end_pts_us from v_frames group by 1, 2)"""


def frames(spark, sf_dir):
    return view(spark, sf_dir, "v_frames")


def shots(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.groupBy("job_id", F.floor(F.col("pts_us") / SHOT).alias("shot_id")).agg(F.min("pts_us").alias("start_pts_us"), (F.max("pts_us") + 1).alias("end_pts_us"))


@query(FR + "select job_id, frame_index, coalesce(lead(pts_us) over (partition by job_id order by pts_us, frame_index) - pts_us, 40000) duration_us from v_frames")
def e01_duration(spark, sf_dir):
    return window.durations(frames(spark, sf_dir), ["job_id"], 40_000).select("job_id", "frame_index", "duration_us")


@query(FR + f"select job_id, frame_index, pts_us from v_frames where pts_us >= {1000 * MIN} and pts_us < {9000 * MIN}")
def a04_frame_scan(spark, sf_dir):
    return window.scan_range(frames(spark, sf_dir), 1000 * MIN, 9000 * MIN).select("job_id", "frame_index", "pts_us")


@query(FR + f"select job_id, frame_index, pts_us, source_pts from v_frames where job_id = 1 and pts_us >= {100 * MIN} order by pts_us, frame_index limit 25")
def a05_read_range(spark, sf_dir):
    return window.scan_range(frames(spark, sf_dir).where("job_id = 1"), 100 * MIN, None, 25).select("job_id", "frame_index", "pts_us", "source_pts")


_TARGETS = f"""targets as (select job_id, unnest(range(0, 12)) n, unnest(range(0, 12)) * {3001 * MIN} at_us from (select distinct job_id from v_frames))"""


@query(FR + ",\n" + _TARGETS + """, c as (select t.job_id, t.n, t.at_us, f.frame_index, f.pts_us, row_number() over (partition by t.job_id, t.n order by abs(f.pts_us - t.at_us), f.pts_us desc, f.frame_index desc) rn from targets t join v_frames f using (job_id))
select job_id, cast(n as bigint) n, cast(at_us as bigint) at_us, frame_index, pts_us from c where rn = 1""")
def a06_nearest_pts(spark, sf_dir):
    f = frames(spark, sf_dir)
    targets = f.select("job_id").distinct().select("job_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("n")).withColumn("at_us", F.col("n") * (3001 * MIN))
    return match.asof_nearest(targets, f, ["job_id"], "at_us", "pts_us", "frame_index", 500 * MIN)


@query(FR.replace("with ", "with recursive ", 1) + f""", r as (select job_id, row_number() over (partition by job_id order by pts_us) rn, pts_us t, lag(pts_us) over (partition by job_id order by pts_us) b from v_frames),
w as (select job_id, rn, t, b, 0::bigint n, t >= 0 taken from r where rn = 1
  union all select r.job_id, r.rn, r.t, r.b, w.n + w.taken::bigint, w.n + w.taken::bigint < 12 and r.t >= (w.n + w.taken::bigint) * {3001 * MIN} from w join r on r.job_id = w.job_id and r.rn = w.rn + 1)
select job_id, n sample, case when b is not null and n * {3001 * MIN} - b < t - n * {3001 * MIN} then b else t end frame_pts, n * {3001 * MIN} target_pts from w where taken""")
def a06_sequential_sample(spark, sf_dir):
    f = frames(spark, sf_dir)
    targets = f.select("job_id").distinct().select("job_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("n")).select("job_id", (F.col("n") * (3001 * MIN)).alias("pts_us"))
    return tracking.sequential_nearest(f, targets, ["job_id"])

@query(FR + """, over_ as (select job_id, frame_index % 7 part, frame_index, pts_us from v_frames), o as (select *, max(pts_us) over (partition by job_id order by part, pts_us, frame_index rows between unbounded preceding and 1 preceding) m from over_)
select job_id, part, frame_index, pts_us from o where m is null or pts_us > m""")
def a15_monotone_assemble(spark, sf_dir):
    parts = frames(spark, sf_dir).select("job_id", (F.col("frame_index") % 7).alias("part"), "frame_index", "pts_us")
    return window.assemble(parts, ["job_id"], ["part", "pts_us", "frame_index"])


@query(FR + """, s as (select job_id, frame_index, pts_us // 3600000000 - 5 p, row_number() over (partition by job_id order by frame_index) rn from v_frames)
select job_id, frame_index, p pts_us, cast(rn + max(case when rn = 1 then greatest(p, 0) else p end - rn) over (partition by job_id order by rn) as bigint) out_pts from s""")
def a16_increasing_pts(spark, sf_dir):
    coarse = frames(spark, sf_dir).select("job_id", "frame_index", (F.expr("pts_us div 3600000000") - 5).alias("pts_us"))
    return window.increasing_pts(coarse, ["job_id"], ["frame_index"])


@query(FR + ",\n" + SHOTS + "\nselect f.job_id, f.frame_index, s.shot_id from v_frames f join shots s on f.job_id = s.job_id and f.pts_us >= s.start_pts_us and f.pts_us < s.end_pts_us")
def c05_shot_of_frame(spark, sf_dir):
    out = match.interval_join(frames(spark, sf_dir), shots(spark, sf_dir), ["job_id"], "pts_us", "start_pts_us", "end_pts_us", SHOT)
    return out.select("job_id", "frame_index", "shot_id")


_CHUNKS = f"""chunks as (select job_id, shot_id, start_pts_us, end_pts_us, unnest(range(0, (end_pts_us - 1 - start_pts_us) // {600 * MIN} + 1)) ordinal from shots),
ch as (select *, start_pts_us + ordinal * {600 * MIN} chunk_start, least(start_pts_us + (ordinal + 1) * {600 * MIN}, end_pts_us) chunk_end from chunks)"""


def chunked(spark, sf_dir):
    return window.chunks(shots(spark, sf_dir), F.lit(600 * MIN).cast("bigint"))


@query(FR + ",\n" + SHOTS + ",\n" + _CHUNKS + """
select job_id, shot_id, cast(ordinal as bigint) ordinal, chunk_start, chunk_end, ordinal % 3 = 0 rescan, printf('shot-%06d-chunk-%06d-%d-%d', shot_id, ordinal, chunk_start, chunk_end) as name from ch""")
def e02_chunks_e10_rescan(spark, sf_dir):
    c = F.col
    out = window.rescans(chunked(spark, sf_dir), 3)
    return out.select("job_id", "shot_id", "ordinal", "chunk_start", "chunk_end", "rescan", window.segment_name(c("shot_id"), c("ordinal"), c("chunk_start"), c("chunk_end")).alias("name"))


@query(FR + ",\n" + SHOTS + ",\n" + _CHUNKS + f"""
select ch.job_id, ch.shot_id, cast(ch.ordinal as bigint) ordinal, cast(count(*) as bigint) context_frames, cast(count(*) filter (pts_us >= chunk_start and pts_us < chunk_end) as bigint) core_frames
from ch join v_frames f on f.job_id = ch.job_id and f.pts_us >= greatest(chunk_start - {45 * MIN}, start_pts_us) and f.pts_us < least(chunk_end + {45 * MIN}, end_pts_us) group by 1, 2, 3""")
def e03_c06_context(spark, sf_dir):
    c, reach = F.col, 45 * MIN
    wide = chunked(spark, sf_dir).withColumn("lo", F.greatest(c("chunk_start") - reach, "start_pts_us")).withColumn("hi", F.least(c("chunk_end") + reach, "end_pts_us"))
    joined = match.interval_join(frames(spark, sf_dir).select("job_id", "pts_us"), wide, ["job_id"], "pts_us", "lo", "hi", 600 * MIN)
    core = (c("pts_us") >= c("chunk_start")) & (c("pts_us") < c("chunk_end"))
    return joined.groupBy("job_id", "shot_id", "ordinal").agg(F.count("*").alias("context_frames"), F.count_if(core).alias("core_frames"))


@query(FR + f"select a.job_id, a.frame_index, b.frame_index ref_frame_index, a.pts_us, b.pts_us ref_pts_us from v_frames a join v_frames b on a.job_id = b.job_id and a.frame_index <> b.frame_index and abs(a.pts_us - b.pts_us) <= {120 * MIN}")
def c07_band_candidates(spark, sf_dir):
    return match.band_self_join(frames(spark, sf_dir), ["job_id"], "pts_us", "frame_index", 120 * MIN)


_MEDIA = "media as (select job_id, case when job_id % 3 = 0 then 30000000 else 40000000 + job_id * 7654321 end duration_us from (select distinct job_id from v_frames)), sh as (select job_id, unnest([0, duration_us // 3, duration_us // 2]) start_pts_us, unnest([duration_us // 3, duration_us // 2, duration_us]) end_pts_us from media)"


@query(FR + ",\n" + _MEDIA + """, p as (
select job_id, duration_us, unnest(range(0, least(duration_us, 20000000) + 1, 750000)) p from media
union all select job_id, duration_us, unnest(range(greatest(0, duration_us - 20000000), duration_us + 1, 750000)) from media where duration_us > 40000000
union all select job_id, duration_us, unnest(range(0, duration_us + 1, 8000000)) from media where duration_us > 40000000
union all select job_id, duration_us, greatest(0, least(duration_us, duration_us * i // 4 + o)) from media, (select unnest([1, 2, 3]) i), (select unnest([-750000, 0, 750000]) o) where duration_us > 40000000
union all select job_id, duration_us, start_pts_us from sh join media using (job_id) union all select job_id, duration_us, (start_pts_us + end_pts_us) // 2 from sh join media using (job_id))
select distinct job_id, cast(p as bigint) pts_us from p where p >= 0 and p < greatest(duration_us, 1)""")
def e07_sample_points(spark, sf_dir):
    media = frames(spark, sf_dir).select("job_id").distinct().withColumn("duration_us", F.when(F.col("job_id") % 3 == 0, 30_000_000).otherwise(40_000_000 + F.col("job_id") * 7_654_321).cast("bigint"))
    third, half = F.expr("duration_us div 3"), F.expr("duration_us div 2")
    cut = F.array(F.struct(F.lit(0).cast("bigint").alias("s"), third.alias("e")), F.struct(third.alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("duration_us").alias("e")))
    parts = media.select("job_id", F.explode(cut).alias("x")).select("job_id", F.col("x.s").alias("start_pts_us"), F.col("x.e").alias("end_pts_us"))
    return window.sample_points(media, parts)


@query(FR + """, r as (select job_id, frame_index, count(*) over (partition by job_id) n from v_frames)
select distinct r.job_id, r.frame_index from r, (select unnest(range(0, 12)) i) where n <= 12 or frame_index = round_even(i * (n - 1) / 11.0::double, 0)""")
def e08_even_sample(spark, sf_dir):
    return window.even_sample(frames(spark, sf_dir).select("job_id", "frame_index"), ["job_id"], ["frame_index"], 12)


@query(FR + "select job_id, frame_index from (select job_id, frame_index, max(frame_index) over (partition by job_id) m from v_frames) where frame_index % 4 = 0 or frame_index = m")
def e09_stride(spark, sf_dir):
    return window.stride_sample(frames(spark, sf_dir).select("job_id", "frame_index"), ["job_id"], ["frame_index"], 4)


@query(FR + """, b as (select job_id, frame_index // 5 s, min(pts_us) st, max(pts_us) en, case when (frame_index // 5) % 6 = 5 then null else round(avg("value") / 100, 6) end d from v_frames group by 1, 2),
c as (select *, sum(case when rn = 1 then 0 when d is null or d >= 0.42 then 1 else 0 end) over (partition by job_id order by st) shot from (select *, row_number() over (partition by job_id order by st) rn from b))
select job_id, cast(shot as bigint) shot, min(st) start_pts_us, max(en) end_pts_us, cast(count(*) as bigint) merged from c group by 1, 2""")
def e05_confirmed_cuts(spark, sf_dir):
    s = F.expr("frame_index div 5")
    raw = frames(spark, sf_dir).groupBy("job_id", s.alias("s")).agg(F.min("pts_us").alias("start_pts_us"), F.max("pts_us").alias("end_pts_us"), F.round(F.avg("value") / 100, 6).alias("d"))
    return window.confirm_cuts(raw.withColumn("distance", F.when(F.col("s") % 6 != 5, F.col("d"))), ["job_id"]).select("job_id", "shot", "start_pts_us", "end_pts_us", "merged")


@query(FR + """, m as (select job_id, frame_index, "value" v, (sum("value") over w - "value") / greatest(count(*) over w - 1, 1) mean from v_frames window w as (partition by job_id order by frame_index rows between 2 preceding and 2 following)),
h as (select *, case when mean > 0 then v / mean when v > 0 then 255 else 0 end r from m), k as (select *, frame_index - lag(frame_index) over (partition by job_id order by frame_index) g from h where r >= 3 and v >= 15)
select job_id, frame_index, round(r, 6) ratio from k where g is null or g >= 10""")
def e06_adaptive_cuts(spark, sf_dir):
    return window.adaptive_cuts(frames(spark, sf_dir), ["job_id"], "value").select("job_id", "frame_index", F.round("ratio", 6).alias("ratio"))


@query(FR.replace("with ", "with recursive ", 1) + """, r as (select job_id, row_number() over (partition by job_id order by frame_index) rn, frame_index, event_type in ('view', 'click') a from v_frames),
w as (select job_id, rn, frame_index, 0::bigint seg, 1::bigint n, a from r where rn = 1
  union all select r.job_id, r.rn, r.frame_index, w.seg + c.new::bigint, case when c.new then 1 else w.n + 1 end, case when c.new then r.a else w.a end
  from w join r on r.job_id = w.job_id and r.rn = w.rn + 1, lateral (select w.n >= 12 or (w.a <> r.a and w.n >= 3) new) c),
s as (select job_id, seg, min(frame_index) lo, max(frame_index) hi, count(*) n, any_value(a) a from w group by 1, 2),
z as (select *, case when seg = max(seg) over (partition by job_id) and n < 3 and seg > 0 then seg - 1 else seg end into_ from s)
select job_id, into_ segment, min(lo) first_frame, max(hi) last_frame, cast(sum(n) as bigint) frames, min_by(a, seg) active from z group by job_id, into_""")
def e04_islands(spark, sf_dir):
    flagged = frames(spark, sf_dir).withColumn("active", F.col("event_type").isin("view", "click"))
    return window.islands(flagged, ["job_id"], "active", 3, 12)

@query(FR + """select job_id, round(sum(0.2 * power(0.8::double, n - rn) * x) + power(0.8::double, max(n)), 9) "scale", cast(count(*) as bigint) observations
from (select job_id, greatest(0.65, least(1.8, "value" / 50)) x, row_number() over (partition by job_id order by frame_index) rn, count(*) over (partition by job_id) n from v_frames) group by job_id""")
def e18_ema(spark, sf_dir):
    return window.ema(frames(spark, sf_dir).withColumn("r", F.col("value") / 50), ["job_id"], ["frame_index"], "r").withColumn("scale", F.round("scale", 9))


@query(FR + """, t as (select job_id, frame_index, frame_index // 12 s, "value" / 100 dx from v_frames)
select job_id, frame_index, round(sum(dx) over (partition by job_id, s order by frame_index), 6) tx, round(sum(dx * 2) over (partition by job_id, s order by frame_index), 6) ty from t""")
def e15_prefix_transforms(spark, sf_dir):
    dx = F.col("value") / 100
    steps = frames(spark, sf_dir).select("job_id", "frame_index", F.array(F.lit(1.0), F.lit(0.0), dx, F.lit(0.0), F.lit(1.0), dx * 2, F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m"))
    out = window.prefix_transforms(steps, ["job_id"], "frame_index")
    return out.select("job_id", "frame_index", F.round(F.get("m", 2), 6).alias("tx"), F.round(F.get("m", 5), 6).alias("ty"))


@query(FR + """, e as (select job_id, frame_index, "value" / 200 s from v_frames), k as (select unnest(range(1, 4)) hops)
select a.job_id, a.frame_index src, a.frame_index + hops dst, round(min(b.s) * exp(-0.0035::double * hops), 9) path_score from e a, k, e b where b.job_id = a.job_id and b.frame_index > a.frame_index and b.frame_index <= a.frame_index + hops group by a.job_id, a.frame_index, hops having count(*) = hops""")
def e16_path_score(spark, sf_dir):
    e = frames(spark, sf_dir).select("job_id", "frame_index", (F.col("value") / 200).alias("s"))
    return window.path_scores(e, ["job_id"], "frame_index", "s", 3).withColumn("path_score", F.round("path_score", 9))


@query(FR + """, m as (select job_id, frame_index // 20 clip, frame_index, "value" v, "value" - lag("value") over (partition by job_id, frame_index // 20 order by frame_index) d from v_frames)
select job_id, clip, round(case when count(*) < 3 then 0 else greatest(0, least(1, greatest(avg(case when d >= 0 then 1.0 when d < 0 then 0 end), avg(case when d <= 0 then 1.0 when d > 0 then 0 end)) * (max(v) - min(v)) / 255)) end, 9) fade from m group by 1, 2""")
def d35_fade(spark, sf_dir):
    from tessera.operators.aggregate import fade_score

    clips = frames(spark, sf_dir).select("job_id", F.expr("frame_index div 20").alias("clip"), "frame_index", "value")
    return fade_score(clips, ["job_id", "clip"], "frame_index", "value").withColumn("fade", F.round("fade", 9))


@query(FR + """select a.job_id, a.frame_index, round(abs(a."value" - b."value"), 9) motion from v_frames a join v_frames b on a.job_id = b.job_id and b.frame_index = a.frame_index - 1""")
def c15_adjacent_frames(spark, sf_dir):
    w = window.in_order(["job_id"], "frame_index")
    out = frames(spark, sf_dir).withColumn("before", F.lag("value").over(w))
    return out.where("before is not null").select("job_id", "frame_index", F.round(F.abs(F.col("value") - F.col("before")), 9).alias("motion"))
