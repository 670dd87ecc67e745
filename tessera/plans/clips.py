"""Queries over made clips (A11, A13, A25, D06, D11-D13, H11, H13, I01, I05, I06, I09-I11), as the tables hold no media.

A row of a table is a clip, whose movement, text box and levels follow from its key, so SQL knows what the kernels must find.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import config
from tessera.operators import kernels, motion
from tessera.plans import repair
from tessera.plans.registry import query
from tessera.sources import checkpoints
from tessera.sources import masks as mask_files
from tessera.sources.shared import Tables, new_path
from tessera.sources.store import Store

WIDTH, HEIGHT = 96, 64


#: Clips of one task; a clip takes some hundredths of a second.
CLIPS = 64


def keys(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("clip"))


def texture(clip: int, height: int = HEIGHT, width: int = WIDTH) -> np.ndarray:
    """A smooth pattern of its own for each clip."""
    rng = np.random.default_rng(clip)
    soft = np.exp(-(np.fft.fftfreq(height)[:, None] ** 2 + np.fft.fftfreq(width)[None, :] ** 2) * 300)
    out = np.real(np.fft.ifft2(np.fft.fft2(rng.normal(size=(height, width))) * soft))
    return np.rint((out - out.min()) / np.ptp(out) * 255).astype(np.uint8)


def box_of(clip: int) -> tuple[int, int, int, int]:
    x, y = 12 + clip % 7, 30 + clip % 5
    return x, y, x + 56, y + 18


def each(rows: DataFrame, f: Callable[[int], list[tuple]], schema: str) -> DataFrame:
    """``f`` of each clip's key; its rows have the key first. The keys of a small file are the work of many tasks, so they are dealt out first."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for clip in batch["clip"].tolist():
                yield pd.DataFrame([(clip, *r) for r in f(clip)], columns=names)

    return rows.repartition(max(1, -(-rows.count() // CLIPS))).mapInPandas(run, schema)


_BOX = "c as (select s_suppkey clip, 12 + s_suppkey % 7 x1, 30 + s_suppkey % 5 y1 from supplier)"


@query(f"with {_BOX} select clip, f frame_index, cast((select count(*) from range(56) a(i), range(18) b(j) where ((x1 + i) // 4) % 2 = 0 and j % 9 > 2) as bigint) mask_px, 0::bigint changed_outside from c, range(3) t(f)")
def a25_synthetic_clip(spark, sf_dir):
    def make(clip):
        return [(i, int((m > 0).sum()), int((a != b).any(axis=2)[m == 0].sum())) for i, a, b, m in kernels.generate_clip(3, WIDTH, HEIGHT, box_of(clip))]

    return each(keys(spark, sf_dir), make, "clip long, frame_index long, mask_px long, changed_outside long")


@query("select s_suppkey clip, cast((s_suppkey % 5) - 2 as bigint) dx, cast((s_suppkey % 3) - 1 as bigint) dy, s_suppkey % 5 = 2 and s_suppkey % 3 = 1 still from supplier")
def i09_registration(spark, sf_dir):
    """A clip that has moved by whole pixels is found to have moved so."""

    def found(clip):
        big = texture(clip, HEIGHT + 12, WIDTH + 12)
        dx, dy = clip % 5 - 2, clip % 3 - 1
        r = motion.register(big[6:-6, 6:-6], big[6 - dy : HEIGHT + 6 - dy, 6 - dx : WIDTH + 6 - dx])
        return [(round(-r.matrix[0, 2]), round(-r.matrix[1, 2]), r.method == "identity")]

    return each(keys(spark, sf_dir), found, "clip long, dx long, dy long, still boolean")


@query("select s_suppkey clip, true flow_helps, true near, 0::bigint trusted_under_mask from supplier")
def i10_alignment(spark, sf_dir):
    """A sheared frame is brought near its target, and nothing is trusted that the source's mask hides."""

    def found(clip):
        big = texture(clip, HEIGHT + 12, WIDTH + 12)
        x, y = motion.grid((HEIGHT, WIDTH))
        source, target = big[6:-6, 6:-6], np.rint(motion.sample(big, 6 + x + 0.02 * y + 1, 6 + y - 0.5)[0]).astype(np.uint8)
        hidden = np.zeros((HEIGHT, WIDTH), np.uint8)
        hidden[20:30, 30:60] = 255
        a = motion.align(source, target, hidden, np.zeros_like(hidden), local=True)
        off = np.abs(a.image.astype(int) - target)[a.confidence > 0.5].mean()
        return [(bool(off < np.abs(source.astype(int) - target).mean()), bool(off < 4), int((a.confidence[a.mask > 0] > 0).sum()))]

    return each(keys(spark, sf_dir), found, "clip long, flow_helps boolean, near boolean, trusted_under_mask long")


@query("select s_suppkey clip, 0.0::double motion from supplier")
def d06_motion(spark, sf_dir):
    """A still clip does not move."""

    def found(clip):
        frames = [texture(clip)] * 3
        return [(round(kernels.motion(frames, [np.zeros((HEIGHT, WIDTH), np.uint8)] * 3), 6),)]

    return each(keys(spark, sf_dir), found, "clip long, motion double")


@query("""with l as (select s_suppkey clip, (60 + s_suppkey % 40) / 255.0::double a, (150 + s_suppkey % 60) / 255.0::double b from supplier),
f as (select clip, pow((a + 0.055) / 1.055, 2.4::double) a, pow((b + 0.055) / 1.055, 2.4::double) b from l)
select clip, round(116 * (cbrt(b) - cbrt(a)), 3) color_delta from f""")
def d11_seam(spark, sf_dir):
    """The Lab distance across the border of an even mask on an even ground."""

    def found(clip):
        x1, y1, x2, y2 = box_of(clip)
        frame, mask = np.full((HEIGHT, WIDTH), 60 + clip % 40, np.uint8), np.zeros((HEIGHT, WIDTH), np.uint8)
        frame[y1:y2, x1:x2], mask[y1:y2, x1:x2] = 150 + clip % 60, 255
        return [(round(kernels.seam([frame], [mask])[0], 3),)]

    return each(keys(spark, sf_dir), found, "clip long, color_delta double")


@query("select s_suppkey clip, 0.0::double still_ratio, 0.0::double still_p95, true lit_flickers from supplier")
def d12_flicker(spark, sf_dir):
    def found(clip):
        x1, y1, x2, y2 = box_of(clip)
        frame, mask = texture(clip), np.zeros((HEIGHT, WIDTH), np.uint8)
        mask[y1:y2, x1:x2] = 255
        lit = [np.where(mask > 0, np.clip(frame.astype(int) + 60 * (i % 2), 0, 255), frame).astype(np.uint8) for i in range(3)]
        ratio, p95 = motion.flicker([frame] * 3, [mask] * 3)
        return [(ratio, p95, bool(motion.flicker(lit, [mask] * 3)[0] > 2))]

    return each(keys(spark, sf_dir), found, "clip long, still_ratio double, still_p95 double, lit_flickers boolean")


def _burned(clip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return next((a, b, m) for _, a, b, m in kernels.generate_clip(1, WIDTH, HEIGHT, box_of(clip)))


@query("select s_suppkey clip, true seen_before, true gone_after from supplier")
def d13_residual_text(spark, sf_dir):
    def found(clip):
        _, burned, mask = _burned(clip)
        before, after = kernels.residual_text([burned], [np.full_like(burned, 128)], [mask])
        return [(before > 0.2, after == 0.0)]

    return each(keys(spark, sf_dir), found, "clip long, seen_before boolean, gone_after boolean")


@query("select s_suppkey clip, true covers, true inside from supplier")
def i01_text_seed(spark, sf_dir):
    """The seed covers most strokes and stays inside the area that it is asked for."""

    def found(clip):
        _, burned, mask = _burned(clip)
        x1, y1, x2, y2 = box_of(clip)
        area = np.zeros_like(mask)
        area[y1:y2, x1:x2] = 255
        seed = kernels.text_seed(burned, area, y2 - y1)
        return [(bool((seed[mask > 0] > 0).mean() > 0.5), bool((seed[area == 0] == 0).all()))]

    return each(keys(spark, sf_dir), found, "clip long, covers boolean, inside boolean")


@query(f"with {_BOX} select clip, cast(x1 - 8 as bigint) px1, cast(y1 - 8 as bigint) py1, cast(x1 + 64 as bigint) px2, cast(y1 + 26 as bigint) py2 from c")
def i05_panel(spark, sf_dir):
    """The largest even bar around a text box."""

    def found(clip):
        x1, y1, x2, y2 = box_of(clip)
        frame = texture(clip)
        frame[y1 - 8 : y2 + 8, x1 - 8 : x2 + 8] = 20
        return [kernels.detect_panel(frame, (x1, y1, x2, y2)) or (None,) * 4]

    return each(keys(spark, sf_dir), found, "clip long, px1 long, py1 long, px2 long, py2 long")


@query("select s_suppkey clip, true found, true confident from supplier")
def i06_text_boxes(spark, sf_dir):
    """The best box of the detector overlaps the burned-in text."""

    def found(clip):
        _, burned, _ = _burned(clip)
        boxes = kernels.detect_text(burned)
        x1, y1, x2, y2 = box_of(clip)
        hit = [b for b in boxes if min(b[2], x2) > max(b[0], x1) and min(b[3], y2) > max(b[1], y1)]
        return [(bool(hit), bool(hit) and max(b[4] for b in hit) > 0.35)]

    return each(keys(spark, sf_dir), found, "clip long, found boolean, confident boolean")


@query(f"with {_BOX} select 'm' || clip || '.npz' path, f frame_index, cast(f * 40000 as bigint) pts_us, cast((select count(*) from range(56) a(i), range(18) b(j) where ((x1 + i) // 4) % 2 = 0 and j % 9 > 2) as bigint) mask_px from c, range(2) t(f)")
def a11_mask_archive(spark, sf_dir):
    """Masks written to archives and read again."""

    def pack(batches):
        for batch in batches:
            packed = [mask_files.export_archive([(i, i * 40_000, m) for i, _, _, m in kernels.generate_clip(2, WIDTH, HEIGHT, box_of(c))]) for c in batch["clip"]]
            yield pd.DataFrame({"path": [f"m{c}.npz" for c in batch["clip"]], "content": packed})

    back = mask_files.import_archive(keys(spark, sf_dir).mapInPandas(pack, "path string, content binary"))
    bits = F.length(F.regexp_replace(F.hex("mask"), "00|(FF)", "$1")) / 2
    return back.select("path", "frame_index", "pts_us", bits.cast("bigint").alias("mask_px"))


@query("select l_orderkey % 4 job_id, l_orderkey segment_id, count(*) frames, cast(sum(l_linenumber) as bigint) total from lineitem where l_orderkey % 8 <> 4 or l_linenumber <= 2 group by 1, 2")
def a13_checkpoints(spark, sf_dir):
    """Segments written as checkpoints, some of them a second time with fewer frames, which replaces the first as a whole."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 4).alias("job_id"), F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").cast("long").alias("frame_index"))
    packed = Tables(spark).write(rows.select("job_id", (F.col("segment_id") % 8).alias("part"), "segment_id", "frame_index"))
    path = new_path(spark)
    frames = packed.select("job_id", F.col("part").alias("segment_id"), F.col("segment_id").alias("source"), "frame_index", F.col("frame_index").alias("pts_us"))
    checkpoints.write(frames, path)
    checkpoints.write(frames.where("segment_id = 4 and frame_index <= 2"), path)
    return checkpoints.read(spark, path).groupBy(F.col("job_id").cast("bigint").alias("job_id"), F.col("source").alias("segment_id")).agg(F.count("*").alias("frames"), F.sum("frame_index").alias("total"))


@query("select cast(s_suppkey as varchar) job_id, cast(s_nationkey as varchar) segment_id, 1::bigint attempt, true passed, 'done' \"action\", cast(s_suppkey % 7 as double) penalty from supplier where s_suppkey % 3 = 0 union all select cast(s_suppkey as varchar), cast(s_nationkey as varchar), 0, false, 'expand_mask', 1.0 from supplier")
def h11_saved_reports(spark, sf_dir):
    """Reports appended in three batches; the last one of a key counts."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("job_id"), F.col("s_nationkey").cast("string").alias("segment_id"), F.col("s_suppkey").alias("k"))
    report = lambda attempt, passed, action, penalty: s.select("job_id", "segment_id", F.lit(attempt).cast("long").alias("attempt"), F.lit(passed).alias("passed"), F.lit(action).alias("action"), penalty.cast("double").alias("penalty"))
    store = Store(spark, new_path(spark))
    for rows in (report(0, False, "expand_mask", F.lit(9.0)), report(0, False, "expand_mask", F.lit(1.0)), report(1, True, "done", F.col("k") % 7).where(F.col("job_id").cast("long") % 3 == 0)):
        store.append("quality_reports", rows)
    return store.latest("quality_reports").select("job_id", "segment_id", "attempt", "passed", "action", "penalty")


@query("""select s_suppkey clip, sha256('{"config":{"a":' || s_suppkey || ',"b":[1,2]},"models":{"m":"' || s_suppkey % 3 || '"}}') hash from supplier""")
def h13_execution_hash(spark, sf_dir):
    from tessera.operators.jobs import execution_hash

    return each(keys(spark, sf_dir), lambda c: [(execution_hash({"b": [1, 2], "a": c}, {"m": str(c % 3)}),)], "clip long, hash string")


@query("select s_suppkey clip, sha256('{\"a\":{\"b\":' || s_suppkey || ',\"c\":2},\"d\":[1]}') hash from supplier")
def a24_config_layers(spark, sf_dir):
    def made(clip):
        tree = config.load([{"a": {"b": 1, "c": 2}}, json.loads(f'{{"a": {{"b": {clip}}}}}')], ["d=[1]"])
        return [(config.stable_hash(tree),)]

    return each(keys(spark, sf_dir), made, "clip long, hash string")


@query("select 'clip' || r_regionkey job_id, f frame_index, cast(f * 83333 as bigint) pts_us, 0::bigint changed_outside, true covered, true nearer from region, range(4) t(f)")
def i11_repair_pipeline(spark, sf_dir):
    """The whole plan over a clip for each region, in chunks and with retries: nothing changes outside masks, and text gives way."""
    jobs = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("id"))
    tables = Tables(spark)
    clips = tables.write(repair.synthetic_of(jobs, frames=4))
    done = repair.run(clips.drop("clean", "truth"), repair.Options(160, 90, chunk_frames=2, max_attempts=2), tables.write)["frames"]

    def laws(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                plane = lambda n, *c, r=r: np.frombuffer(getattr(r, n), np.uint8).reshape(r.height, r.width, *c).astype(int)
                truth, off = plane("truth") > 0, plane("mask") == 0
                error = [np.abs(plane(n, 3) - plane("clean", 3))[truth].mean() for n in ("output", "pixels")]
                rows.append((r.job_id, r.frame_index, r.pts_us, int((plane("pixels", 3) != plane("output", 3)).any(axis=2)[off].sum()), bool((plane("mask")[truth] > 0).mean() > 0.6), bool(error[0] < 0.6 * error[1])))
            yield pd.DataFrame(rows, columns=["job_id", "frame_index", "pts_us", "changed_outside", "covered", "nearer"])

    return done.join(clips.select("job_id", "frame_index", "clean", "truth"), ["job_id", "frame_index"]).mapInPandas(laws, "job_id string, frame_index long, pts_us long, changed_outside long, covered boolean, nearer boolean")
