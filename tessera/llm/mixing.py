"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document's rate r minimises its relative entropy to one copy, subject to its source's words summing to
the source's target and to ``0 <= r <= cap``. The convex dual has one multiplier for each source, and the
rates are an exponential tilt by document size: ``r = min(cap, exp(lambda * size / mean size))``.

Newton steps on the logarithm of the dual's gradient find all multipliers at once. They run over the exact
histogram (source, size, documents), not over documents, and every step is kept in a bracket, so it can't
leave the solution. A source whose target is its cap has every document at the cap.

Rates become whole copies by systematic rounding over documents in order of size: a running sum of the
fractions decides where it passes a whole number. The words then still missing or in excess (less than
the largest document) are made up from the smallest documents on. Which documents of one source and size get the extra
copy is decided by a seeded hash, ranked inside hash buckets, so that no source, size or group of copies has to meet in one task.
Repeated rows are one row with their number throughout.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import Tables, running, source_key

#: Fractions of a copy are counted in parts of this many, so that sums don't depend on their order.
UNIT = 1_000_000
ROWS_PER_BUCKET = 512


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """(sk, source_size) with its target: shares of all words by weight, filled up to ``cap`` times the size.

    Sources take ``weights`` in turn, in order of sk. The level at which weights are filled follows from the
    sources in order of the level at which each is full: the first that is not full at the level of the rest fixes it.
    """
    w = Window.orderBy("sk")
    turn = (F.row_number().over(w) - 1) % len(weights)
    weighed = sizes.select("sk", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1).alias("weight"))
    full = F.col("source_size") * float(cap)
    order = Window.orderBy(full / F.col("weight"), "sk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    total, weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    level = (total - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.select("*", full.alias("full"), level.alias("level"), F.row_number().over(order).alias("at"))
    first = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("at"))).over(every)
    return leveled.select("sk", "source_size", F.least("full", F.col("weight") * first).alias("target"))


def _solve(hist: DataFrame, wanted: DataFrame, cap: int, tables: Tables, tolerance: float = 1e-10, steps: int = 4, rounds: int = 25) -> DataFrame:
    """(sk, source_size, target, mean, lam); lam is null where every document is at the cap."""
    ln_cap = F.log(F.lit(float(cap)))
    shape = hist.where("size > 0").groupBy("sk").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = wanted.join(shape, "sk").where("target > 0")
    x_min = F.col("least") / F.col("mean")
    grows = F.col("target") >= F.col("source_size")
    at_cap = F.col("target") >= F.col("source_size") * (cap - 1e-9)
    state = state.select(
        "sk", "source_size", "target", "mean",
        F.when(grows, F.lit(0.0)).otherwise(F.log(F.col("target") / F.col("source_size")) / x_min).alias("lo"),
        F.when(grows, ln_cap / x_min).otherwise(F.lit(0.0)).alias("hi"),
        F.when(~at_cap, F.lit(0.0)).alias("lam"),
        F.lit(1.0).alias("gap"),
    )
    state = tables.write(state)
    cells = hist.where("size > 0").select("sk", F.col("size").alias("c"), "n")
    for _ in range(rounds):
        open_ = state.where(F.col("lam").isNotNull() & (F.col("gap") > tolerance))
        done = state.where(F.col("lam").isNull() | (F.col("gap") <= tolerance))
        for _ in range(steps):
            x = F.col("c") / F.col("mean")
            tilt = F.exp(F.least(F.col("lam") * x, ln_cap))
            words = F.col("n") * F.col("c") * tilt
            slope = F.sum(F.when(F.col("lam") * x < ln_cap, words * x).otherwise(0.0))
            sums = cells.join(open_, "sk").groupBy("sk", "source_size", "target", "mean", "lo", "hi", "lam").agg(F.sum(words).alias("g"), slope.alias("h"))
            lo = F.when(F.col("g") <= F.col("target"), F.col("lam")).otherwise(F.col("lo"))
            hi = F.when(F.col("g") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
            step = F.col("lam") + F.log(F.col("target") / F.col("g")) * F.col("g") / F.when(F.col("h") > 0, F.col("h"))
            gap = F.abs(F.col("g") / F.col("target") - 1)
            next_ = F.when(gap <= tolerance, F.col("lam")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
            gap = F.when((hi - lo) <= 1e-14 * (F.abs(lo) + F.abs(hi)), F.lit(0.0)).otherwise(gap)
            open_ = sums.select("sk", "source_size", "target", "mean", lo.alias("lo"), hi.alias("hi"), next_.alias("lam"), gap.alias("gap"))
        new = tables.write(done.unionByName(open_))
        tables.drop(state)
        state = new
        if state.where(F.col("lam").isNotNull() & (F.col("gap") > tolerance)).isEmpty():
            break
    return state.select("sk", "target", "mean", "lam")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, rows_per_bucket: int = ROWS_PER_BUCKET, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each document: id, source, size, source_size, target, rate, copies.

    Null and empty texts have size 0 and are taken at one copy: they cost no words. Null is a source of its own and the last. Repeated rows are
    documents of their own. A table without words has targets of 0. The same rows and seed give the same copies.
    """
    light = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), F.lit(0).cast("long").alias("r"))
    each = _mixed(light, weights, cap, seed, rows_per_bucket).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    copies = (F.col("whole") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return each.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "rate", copies.alias("copies"))


def _mixed(light: DataFrame, weights: tuple[float, ...], cap: int, seed: int, rows_per_bucket: int) -> DataFrame:
    """For the rows (id, source, text, r) of ``light``, a row for each distinct one: n of them take ``whole`` copies each and ``extra`` of them one more."""
    tables = Tables(light.sparkSession)
    h = F.xxhash64(F.col("id"), F.col("text"), F.lit(seed))
    base = light.select("id", "source", source_key(F.col("source")).alias("sk"), word_count(F.col("text")).alias("size"), h.alias("h"), "r")
    base = tables.write(base.groupBy(*base.columns).agg(F.count("*").alias("n")))
    buckets = max(1, ceil((base.agg(F.sum("n")).first()[0] or 0) / rows_per_bucket))
    base = base.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 8), F.lit(buckets)))

    parts = tables.write(base.groupBy("sk", "size", "bucket").agg(F.sum("n").alias("n")))
    hist = tables.write(parts.groupBy("sk", "size").agg(F.sum("n").alias("n")))
    wanted = tables.write(targets(hist.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap))
    solved = _solve(hist, wanted, cap, tables)

    by_size = Window.partitionBy("sk").orderBy("size")
    rate = F.round(F.when(F.col("size") == 0, 1.0).when(F.col("target") == 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(cap)))))), 9)
    cells = hist.join(wanted, "sk").join(solved.drop("target"), "sk", "left").select("sk", "size", "n", "source_size", "target", rate.alias("rate"))
    cells = cells.select("*", F.floor("rate").alias("whole"), F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long").alias("frac"))
    run = F.sum(F.col("n") * F.col("frac")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)) + UNIT // 2
    up = F.floor(run / UNIT) - F.floor((run - F.col("n") * F.col("frac")) / UNIT)
    cells = cells.select("*", F.least(up, F.col("n")).alias("up"))
    every = Window.partitionBy("sk")
    missing = F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("up"))).over(every)
    can = F.when(F.col("size") == 0, 0).when(missing > 0, F.when(F.col("whole") < cap, F.col("n") - F.col("up")).otherwise(0)).otherwise(F.col("up"))
    cells = cells.select("*", missing.alias("missing"), can.alias("can"))
    used = F.coalesce(F.sum(F.col("size") * F.col("can")).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.col("can"), F.greatest(F.floor((F.abs("missing") - used) / F.greatest("size", F.lit(1))), F.lit(0)))
    cells = cells.select("sk", "size", "source_size", "target", "rate", "whole", (F.col("up") + F.when(F.col("missing") > 0, more).otherwise(-more)).alias("up"))
    decided = tables.write(running(parts, ["sk", "size"], "bucket", "n", "ahead").drop("n").join(cells, ["sk", "size"]))

    earlier = F.sum("n").over(Window.partitionBy("sk", "size", "bucket").orderBy("h", "id", "r").rowsBetween(Window.unboundedPreceding, -1))
    out = base.join(decided, ["sk", "size", "bucket"]).withColumn("before", F.col("ahead") + F.coalesce(earlier, F.lit(0)))
    extra = F.least(F.col("n"), F.greatest(F.col("up") - F.col("before"), F.lit(0)))
    return out.select("id", "source", "h", "r", "n", "size", "source_size", "target", "rate", F.col("whole").cast("long").alias("whole"), extra.cast("long").alias("extra"))


def repeat(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, rows_per_bucket: int = ROWS_PER_BUCKET, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture itself: every document as often as the mix takes it, with all of its columns.

    Rows are told apart by all of their columns, so reruns agree where rows of one id and text differ in others.
    """
    r = F.xxhash64(*[F.col(c) for c in docs.columns])
    light = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), r.alias("r"))
    taken = _mixed(light, weights, cap, seed, rows_per_bucket).select("h", "r", (F.col("n") * F.col("whole") + F.col("extra")).alias("copies")).where("copies > 0")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text), F.lit(seed)).alias("h"), r.alias("r"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.groupBy("h", "r").agg(F.any_value("row").alias("row"))
    return rows.join(taken, ["h", "r"]).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
