"""Sequences over media time: durations, chunks, samples, gap filling, monotone times, shots, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def in_order(key: list[str], *order: str) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def durations(frames: DataFrame, key: list[str], last_us: Column | int, pts: str = "pts_us") -> DataFrame:
    """With duration_us: the time to the next frame; ``last_us`` for the last one."""
    fallback = F.lit(last_us) if isinstance(last_us, int) else last_us
    return frames.withColumn("duration_us", F.coalesce(F.lead(pts).over(in_order(key, pts, "frame_index")) - F.col(pts), fallback.cast("bigint")))


def scan_range(frames: DataFrame, start: int | None = None, end: int | None = None, cap: int | None = None, pts: str = "pts_us") -> DataFrame:
    """Frames of [start, end), which reaches the Parquet scan as a filter; the first ``cap`` in time if given."""
    out = frames
    if start is not None:
        out = out.where(F.col(pts) >= start)
    if end is not None:
        out = out.where(F.col(pts) < end)
    return out if cap is None else out.orderBy(pts, "frame_index").limit(cap)


def chunk_width(fps: Column) -> Column:
    """Micros of a chunk: 32 frames, kept within 8 and 96."""
    return F.bround(F.lit(max(8, min(96, 32))) / fps * MICROS).cast("bigint")


def chunks(shots: DataFrame, width: Column) -> DataFrame:
    """Half-open chunks from the shot's start, the last one clipped: ordinal, chunk_start, chunk_end."""
    many = shots.withColumn("_w", width)
    starts = F.sequence(F.col("start_pts_us"), F.col("end_pts_us") - 1, F.col("_w"))
    out = many.where(F.col("end_pts_us") > F.col("start_pts_us")).select(*shots.columns, "_w", F.posexplode(starts).alias("ordinal", "chunk_start"))
    return out.select(*shots.columns, F.col("ordinal").cast("bigint").alias("ordinal"), "chunk_start", F.least(F.col("chunk_start") + F.col("_w"), "end_pts_us").alias("chunk_end"))


def segment_name(shot: Column, ordinal: Column, start: Column, end: Column) -> Column:
    return F.format_string("shot-%06d-chunk-%06d-%d-%d", shot, ordinal, start, end)


def sample_points(media: DataFrame, shots: DataFrame, key: str = "job_id", step: float = 0.75, head: float = 20, tail: float = 20, middle: int = 3, rescan: float = 8.0) -> DataFrame:
    """Times at which to look for text: key, pts_us, distinct. ``media``: key, duration_us; ``shots``: key, start_pts_us, end_pts_us.

    The first ``head`` seconds by ``step``; of media longer than head and tail also the last ones, a few middle windows and a wide grid; every shot's start and middle.
    """
    s, h, t, r = (int(x * MICROS) for x in (step, head, tail, rescan))
    d, zero = F.col("duration_us"), F.lit(0).cast("bigint")
    long_ = d > h + t
    lists = [F.sequence(zero, F.least(d, F.lit(h)), F.lit(s).cast("bigint")), F.when(long_, F.sequence(F.greatest(zero, d - t), d, F.lit(s).cast("bigint"))), F.when(long_, F.sequence(zero, d, F.lit(r).cast("bigint")))]
    for i in range(1, middle + 1):
        center = F.expr(f"duration_us * {i} div {middle + 1}")
        lists.append(F.when(long_, F.array(*[F.greatest(zero, F.least(d, center + o)) for o in (-s, 0, s)])))
    grid = media.select(key, "duration_us", F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("pts_us"))
    of_shots = shots.join(media, key).select(key, "duration_us", F.explode(F.array(F.col("start_pts_us"), F.expr("(start_pts_us + end_pts_us) div 2"))).alias("pts_us"))
    return grid.unionByName(of_shots).where((F.col("pts_us") >= 0) & (F.col("pts_us") < F.greatest(d, F.lit(1)))).select(key, "pts_us").distinct()


def even_sample(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of each key at evenly spaced ranks, first and last included; all where there are no more."""
    w = in_order(key, *order)
    ranked = rows.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    # the rank i * (N - 1) / (n - 1), half-even, for some i: the nearest i is the only candidate
    i = F.bround(F.col("_rn") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return ranked.where((F.col("_n") <= n) | (F.bround(i * (F.col("_n") - 1) / max(n - 1, 1)) == F.col("_rn"))).drop("_rn", "_n")


def stride_sample(rows: DataFrame, key: list[str], order: list[str], stride: int) -> DataFrame:
    """Every ``stride``-th row, and the last."""
    w = in_order(key, *order)
    ranked = rows.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return ranked.where((F.col("_rn") % stride == 0) | (F.col("_rn") == F.col("_n") - 1)).drop("_rn", "_n")


def rescans(chunk_rows: DataFrame, every: int) -> DataFrame:
    return chunk_rows.withColumn("rescan", F.col("ordinal") % every == 0)


def gap_fill(rows: DataFrame, key: list[str], frame: str, lerp: list[str], confidence: str = "confidence", most: int = 8, decay: float = 0.72) -> DataFrame:
    """With rows for missing frames between two of at most ``most + 1`` apart: linear in ``lerp``, confidence ``decay`` times the smaller, propagated true."""
    w = in_order(key, frame)
    nxt = {c: F.lead(c).over(w) for c in [frame, confidence, *lerp]}
    seen = rows.select(*key, frame, confidence, *lerp, *[v.alias(f"_n_{c}") for c, v in nxt.items()])
    gap = F.col(f"_n_{frame}") - F.col(frame)
    holes = seen.where((gap > 1) & (gap <= most + 1)).withColumn("_f", F.explode(F.sequence(F.col(frame) + 1, F.col(f"_n_{frame}") - 1)))
    t = (F.col("_f") - F.col(frame)) / gap
    filled = holes.select(*key, F.col("_f").alias(frame), (decay * F.least(F.col(confidence), F.col(f"_n_{confidence}"))).alias(confidence), *[(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * t).alias(c) for c in lerp], F.lit(True).alias("propagated"))
    return seen.select(*key, frame, confidence, *[F.col(c).cast("double").alias(c) for c in lerp], F.lit(False).alias("propagated")).unionByName(filled)


def assemble(frames: DataFrame, key: list[str], order: list[str], pts: str = "pts_us") -> DataFrame:
    """Frames in order whose time is later than all before them."""
    before = F.max(pts).over(in_order(key, *order).rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(pts) > F.col("_before"))).drop("_before")


def increasing_pts(frames: DataFrame, key: list[str], order: list[str], pts: str = "pts_us", to: str = "out_pts") -> DataFrame:
    """Times pushed up to be strictly increasing: ``max(last + 1, pts)``, the first at least 0; in closed form, without a fold."""
    rn = F.row_number().over(in_order(key, *order)).cast("bigint")
    ranked = frames.withColumn("_rn", rn)
    floor0 = F.when(F.col("_rn") == 1, F.greatest(F.col(pts), F.lit(0))).otherwise(F.col(pts))
    peak = F.max(floor0 - F.col("_rn")).over(in_order(key, "_rn").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(to, F.col("_rn") + peak).drop("_rn")


def confirm_cuts(shots: DataFrame, key: list[str], distance: str = "distance", least: float = 0.42) -> DataFrame:
    """Shots merged over boundaries that are not confirmed: one is if its distance is at least ``least`` or null (unreadable)."""
    w = in_order(key, "start_pts_us")
    cut = F.when(F.row_number().over(w) == 1, 0).when(F.col(distance).isNull() | (F.col(distance) >= least), 1).otherwise(0)
    grouped = shots.withColumn("_cut", cut).withColumn("shot", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*key, "shot").agg(F.min("start_pts_us").alias("start_pts_us"), F.max("end_pts_us").alias("end_pts_us"), F.count("*").alias("merged"))


def adaptive_cuts(frames: DataFrame, key: list[str], score: str, ratio: float = 3.0, least: float = 15.0, window: int = 2, min_gap: int = 10) -> DataFrame:
    """Frames whose score is at least ``least`` and ``ratio`` times the mean of ``window`` neighbours on each side, ``min_gap`` frames from the candidate before."""
    w = in_order(key, "frame_index")
    around = w.rowsBetween(-window, window)
    mean = (F.sum(score).over(around) - F.col(score)) / F.greatest(F.count(score).over(around) - 1, F.lit(1))
    scored = frames.withColumn("ratio", F.when(mean > 0, F.col(score) / mean).otherwise(F.when(F.col(score) > 0, 255.0).otherwise(0.0)))
    hits = scored.where((F.col("ratio") >= ratio) & (F.col(score) >= least))
    return hits.withColumn("_gap", F.col("frame_index") - F.lag("frame_index").over(w)).where(F.col("_gap").isNull() | (F.col("_gap") >= min_gap)).drop("_gap")


def islands(frames: DataFrame, key: list[str], active: str, min_run: int, max_run: int) -> DataFrame:
    """Runs of a flag: a run ends where the flag flips after at least ``min_run`` frames, or at ``max_run``; a last run below ``min_run`` joins the one before.

    Rows: key, segment, first_frame, last_frame, frames, active (of its first frame). One key's flags are folded in order.
    """
    flags = frames.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("frame_index", F.col(active).alias("a")))).alias("f"))
    run = "struct<first:bigint,last:bigint,n:bigint,a:boolean>"
    one = lambda x: F.struct(x["frame_index"].cast("bigint").alias("first"), x["frame_index"].cast("bigint").alias("last"), F.lit(1).cast("bigint").alias("n"), x["a"].alias("a"))

    def step(acc: Column, x: Column) -> Column:
        end = F.try_element_at(acc, F.lit(-1))
        new = end.isNull() | (end["n"] >= max_run) | ((end["a"] != x["a"]) & (end["n"] >= min_run))
        longer = F.struct(end["first"].alias("first"), x["frame_index"].cast("bigint").alias("last"), (end["n"] + 1).alias("n"), end["a"].alias("a"))
        return F.when(new, F.concat(acc, F.array(one(x)))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)))

    def tail(acc: Column) -> Column:
        end, prev = F.try_element_at(acc, F.lit(-1)), F.try_element_at(acc, F.lit(-2))
        merged = F.struct(prev["first"].alias("first"), end["last"].alias("last"), (prev["n"] + end["n"]).alias("n"), prev["a"].alias("a"))
        return F.when((F.size(acc) > 1) & (end["n"] < min_run), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 2, F.lit(0))), F.array(merged))).otherwise(acc)

    folded = F.aggregate("f", F.array().cast(f"array<{run}>"), step, tail)
    return flags.select(*key, F.posexplode(folded).alias("segment", "r")).select(*key, F.col("segment").cast("bigint").alias("segment"), F.col("r.first").alias("first_frame"), F.col("r.last").alias("last_frame"), F.col("r.n").alias("frames"), F.col("r.a").alias("active"))


def ema(rows: DataFrame, key: list[str], order: list[str], ratio: str, keep: float = 0.8, lo: float = 0.65, hi: float = 1.8) -> DataFrame:
    """Per key the calibration after all observations: ``keep * s + (1 - keep) * clip(ratio, lo, hi)`` from 1, in order.

    In closed form: each observation's weight depends only on how many follow.
    """
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])) - 1
    x = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(ratio)))
    weighed = rows.select(*key, rn.alias("_after"), x.alias("_x"))
    return weighed.groupBy(*key).agg((F.sum((1 - keep) * F.pow(F.lit(keep), F.col("_after")) * F.col("_x")) + F.pow(F.lit(keep), F.count("*"))).alias("scale"), F.count("*").alias("observations"))


def prefix_transforms(steps: DataFrame, key: list[str], order: str, anchor: int = 12) -> DataFrame:
    """Products of adjacent 3 x 3 transforms (array m of nine, row-major) since the last anchor; every ``anchor``-th frame starts again from its own.

    Matrices don't commute, so each stretch between anchors (``anchor`` rows at most) is folded in order.
    """
    ranked = steps.withColumn("_rn", F.row_number().over(in_order(key, order)) - 1).withColumn("_stretch", F.floor(F.col("_rn") / anchor))
    packed = ranked.groupBy(*key, "_stretch").agg(F.array_sort(F.collect_list(F.struct(order, "m"))).alias("f"))
    eye = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    mul = lambda a, b: F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])
    kind = "array<struct<at:bigint,m:array<double>>>"
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x[order].cast("bigint").alias("at"), mul(x["m"], F.coalesce(F.try_element_at(acc, F.lit(-1))["m"], eye)).alias("m"))))
    folded = F.aggregate("f", F.array().cast(kind), step)
    return packed.select(*key, F.explode(folded).alias("r")).select(*key, F.col("r.at").alias(order), F.col("r.m").alias("m"))


def path_scores(edges: DataFrame, key: list[str], order: str, score: str, reach: int) -> DataFrame:
    """For frames up to ``reach`` steps apart: the smallest adjacent score between them times ``exp(-0.0035 * steps)``. ``score`` at i is of the step from i - 1 to i."""
    targets = edges.select(*key, F.col(order).alias("src"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("hops"))
    pieces = targets.select(*key, "src", "hops", F.explode(F.sequence(F.lit(1), F.col("hops"))).alias("h")).withColumn("at", F.col("src") + F.col("h"))
    adjacent = edges.select(*key, F.col(order).alias("at"), F.col(score).alias("s"))
    joined = pieces.join(adjacent, [*key, "at"]).groupBy(*key, "src", "hops").agg(F.min("s").alias("low"), F.count("*").alias("n")).where(F.col("n") == F.col("hops"))
    return joined.select(*key, "src", (F.col("src") + F.col("hops")).alias("dst"), (F.col("low") * F.exp(-0.0035 * F.col("hops"))).alias("path_score"))


def temporal_union(pixels: DataFrame, key: list[str], frame: str, value: str, radius: int, to: str) -> DataFrame:
    """Per pixel (``key``) the largest value within ``radius`` frames."""
    return pixels.withColumn(to, F.max(value).over(Window.partitionBy(*key).orderBy(frame).rangeBetween(-radius, radius)))


def even_ranks(total: int, n: int) -> list[int]:
    """What ``even_sample`` keeps, for checks."""
    if total <= n:
        return list(range(total))
    return sorted({round(i * (total - 1) / (n - 1)) for i in range(n)}) if n > 1 else [0]


def cadence(duration_s: Column) -> Column:
    return F.when(duration_s <= 12, F.exp(-F.pow((duration_s - 2.7) / 3.5, F.lit(2.0)))).otherwise(0.15)

