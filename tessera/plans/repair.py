"""The whole dataflow from frames to repaired, checked segments, as one plan keyed by job, shot and chunk.

frames -> detections -> tracks -> classes -> masks -> clean plates -> features -> routes -> repair -> quality gate -> retry.
Relational steps are DataFrame operators; only pixel kernels run in Python, each over one frame or one chunk. Retries pass only
failing segments again, with wider masks or a forced route.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import aggregate, decide, engines, kernels, masks, match, motion, tracking, window

SEGMENT = ["job_id", "shot_id", "chunk"]


@dataclass(frozen=True)
class Options:
    width: int
    height: int
    chunk_frames: int = 32
    uncertain: str = "remove"
    dilation: float = 0.12
    feather: int = 3
    max_attempts: int = 5


def _plane(row, name: str = "pixels", channels: int | None = None) -> np.ndarray:
    c = row.channels if channels is None else channels
    return np.frombuffer(row[name] if isinstance(row, dict) else getattr(row, name), np.uint8).reshape((row.height, row.width, c) if c > 1 else (row.height, row.width))


def detect(frames: DataFrame) -> DataFrame:
    """Text boxes of each frame, with their mean colour and local contrast."""
    kind = "job_id string, shot_id long, frame_index long, pts_us long, x1 int, y1 int, x2 int, y2 int, confidence double, angle double, look0 double, look1 double, look2 double, contrast double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                image = _plane(r)
                g = kernels.gray(image).astype(float)
                for x1, y1, x2, y2, c in kernels.detect_text(image):
                    pad = max(4, round((y2 - y1) * 0.35))
                    inner, patch = g[y1:y2, x1:x2], g[max(0, y1 - pad) : y2 + pad, max(0, x1 - pad) : x2 + pad]
                    contrast = float(np.clip((inner.std() + abs(inner.mean() - patch.mean())) / 96, 0, 1))
                    rows.append((r.job_id, r.shot_id, r.frame_index, r.pts_us, x1, y1, x2, y2, c, 0.0, *kernels.appearance(image, (x1, y1, x2, y2)).tolist(), contrast))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    found = frames.mapInPandas(run, kind)
    order = [-F.col("confidence"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")]
    kept = match.greedy_keep(found, ["job_id", "shot_id", "frame_index"], order, 0.72)
    return kept.withColumn("det_id", F.xxhash64("job_id", "shot_id", "frame_index", "x1", "y1", "x2", "y2"))


def removable_boxes(detections: DataFrame, shots: DataFrame, o: Options) -> DataFrame:
    """Boxes to remove on each frame, gaps filled, with their track's score. ``shots``: job_id, shot_id, frames."""
    tracked = detections.join(tracking.track(detections, ["job_id", "shot_id"], width=o.width, height=o.height), ["job_id", "shot_id", "det_id"]).join(shots, ["job_id", "shot_id"])
    features = aggregate.track_features(tracked, ["job_id", "shot_id", "track_id"], o.width, o.height, F.max("frames"), F.avg("contrast"))
    classes = aggregate.classify_tracks(features, o.width).where(masks.removable(F.col("class"), o.uncertain)).select("job_id", "shot_id", "track_id", F.col("score").alias("track_score"))
    filled = window.gap_fill(tracked, ["job_id", "shot_id", "track_id"], "frame_index", ["x1", "y1", "x2", "y2"])
    whole = [F.bround(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return filled.join(classes, ["job_id", "shot_id", "track_id"]).select("job_id", "shot_id", "frame_index", *whole, "confidence", "track_score")


def with_masks(frames: DataFrame, boxes: DataFrame, o: Options, expand: str = "mask_expand_px") -> DataFrame:
    """Frames (with ``expand``) and their mask plane: strokes inside boxes, grown, closed, filled, and joined with the neighbours' masks."""
    packed = boxes.groupBy("job_id", "shot_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2", "track_score"))).alias("boxes"))
    joined = frames.join(packed, ["job_id", "shot_id", "frame_index"], "left")
    least, most = (5, 11) if o.height >= 900 else (3, 7)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                image, mask = _plane(r), np.zeros((r.height, r.width), np.uint8)
                extra = int(getattr(r, expand))
                for b in r.boxes if r.boxes is not None else []:
                    area, line = np.zeros_like(mask), max(1, b["y2"] - b["y1"])
                    area[max(0, b["y1"]) : b["y2"], max(0, b["x1"]) : b["x2"]] = 255
                    mask |= kernels.grow_text(kernels.text_seed(image, area, line), line, o.dilation, least + extra, most + extra)
                    panel = kernels.detect_panel(image, (b["x1"], b["y1"], b["x2"], b["y2"]), max(0.72, b["track_score"] * 0.86)) if b["track_score"] >= 0.72 else None
                    if panel:
                        mask[panel[1] : panel[3], panel[0] : panel[2]] = 255
                out.append(kernels.drop_small(kernels.fill_holes(kernels.closed(mask, kernels.rect(3, 3))), 6).tobytes())
            yield batch.drop(columns="boxes").assign(mask=out)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema)
    return joined.select(*frames.columns, "boxes").mapInPandas(run, f"{kind}, mask binary")


def reconstruct(masked: DataFrame, o: Options) -> DataFrame:
    """Each chunk's frames with clean plates, residual masks and their measures; masks joined over one frame on each side."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in masked.schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index", ignore_index=True)
        rows = list(pdf.itertuples(index=False))
        images, raw = [_plane(r) for r in rows], [_plane(r, "mask", 1) for r in rows]
        wide = [np.maximum.reduce(raw[max(0, i - 1) : i + 2]) for i in range(len(raw))]
        plates, left, coverage, shifts = [], [], [], kernels.places(images)
        for i, m in enumerate(wide):
            plate, residual = kernels.clean_plate(images, wide, i, 2, shifts) if m.any() else (images[i], np.zeros_like(m))
            plates.append(plate)
            left.append(residual)
            coverage.append(1 - (residual > 0).sum() / max((m > 0).sum(), 1))
        return pdf.assign(mask=[m.tobytes() for m in wide], plate=[p.tobytes() for p in plates], residual=[x.tobytes() for x in left], coverage=coverage, mask_px=[int((m > 0).sum()) for m in wide], residual_px=[int((x > 0).sum()) for x in left], component_px=[kernels.largest_component(x) for x in left])

    return masked.groupBy(*SEGMENT).applyInPandas(one, f"{kind}, plate binary, residual binary, coverage double, mask_px long, residual_px long, component_px long")


def features(plates: DataFrame, o: Options) -> DataFrame:
    """A row for each segment with what the router reads."""
    frame = plates.select(*SEGMENT, "coverage", F.col("coverage").alias("confidence"), (F.col("mask_px") > 0).alias("has_mask"), "mask_px", "residual_px", "component_px")
    rolled = aggregate.clean_plate_rollup(frame, SEGMENT)
    size = frame.groupBy(*SEGMENT).agg(F.count("*").alias("frame_count"), F.avg(F.col("mask_px") / (o.width * o.height)).alias("mask_ratio_of_frame"))

    def change(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("frame_index").itertuples(index=False))
        on = [_plane(r, "mask", 1) for r in rows]
        share = lambda ims, q: [float(np.percentile(np.abs(kernels.gray(a).astype(float) - kernels.gray(b))[m > 0] / 255, q)) for a, b, m in zip(ims, ims[1:], on[1:], strict=False) if m.any()]
        cross, flick = share([_plane(r) for r in rows], 85), share([_plane(r, "plate") for r in rows], 90)
        clipped = lambda v, k: float(np.clip(k * np.mean(v), 0, 1)) if v else 0.0
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in SEGMENT), clipped(cross, 2.5), clipped(flick, 2.2), kernels.motion([_plane(r) for r in rows], on))], columns=[*SEGMENT, "foreground_crossing_score", "flicker_risk", "motion_score"])

    moved = plates.select(*SEGMENT, "frame_index", "height", "width", "channels", "pixels", "mask", "plate").groupBy(*SEGMENT).applyInPandas(change, "job_id string, shot_id long, chunk long, foreground_crossing_score double, flicker_risk double, motion_score double")
    out = size.join(rolled, SEGMENT).join(moved, SEGMENT)
    return out.select(*SEGMENT, "frame_count", "mask_ratio_of_frame", F.col("coverage").alias("mean_clean_plate_coverage"), F.col("confidence").alias("mean_clean_plate_confidence"), F.col("confidence").alias("mean_flow_confidence"), "foreground_crossing_score", "flicker_risk", "motion_score", F.coalesce("largest", F.lit(0)).alias("largest_residual_component_px"), F.col("residual_ratio").alias("residual_mask_ratio_of_roi"))


def repaired(plates: DataFrame, routed: DataFrame, o: Options) -> DataFrame:
    """Frames with output planes and the segment's quality measures."""
    joined = plates.join(routed.select(*SEGMENT, "engine", F.col("runs").alias("route")), SEGMENT)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index", ignore_index=True)
        rows = list(pdf.itertuples(index=False))
        images, on = [_plane(r) for r in rows], [_plane(r, "mask", 1) for r in rows]
        out = []
        for r, image, m in zip(rows, images, on, strict=True):
            made, rest = _plane(r, "plate"), _plane(r, "residual", 1)
            if r.route == "copy" or not m.any():
                out.append(image)
                continue
            if r.engine is not None and rest.any():
                made = engines.REGISTRY[r.engine].repair(made, rest)
            out.append(kernels.composite_exact(image, made, m, o.feather, seed=int(r.frame_index)))
        before, after = kernels.residual_text(images, out, on)
        ratio, p95 = motion.flicker(out, on)
        color, gradient = kernels.seam(out, on)
        return pdf.assign(output=[x.tobytes() for x in out], residual_before=before, residual_after=after, flicker_ratio=ratio, flicker_p95=p95, color_delta=color, gradient_ratio=gradient, outside_error=kernels.outside_error(images, out, on), sharpness=kernels.sharpness(out, on))

    names = "residual_before residual_after flicker_ratio flicker_p95 color_delta gradient_ratio outside_error sharpness"
    return joined.groupBy(*SEGMENT).applyInPandas(one, f"{kind}, output binary, " + ", ".join(f"{n} double" for n in names.split()))


def run(frames: DataFrame, o: Options, table=lambda df: df.persist()) -> dict[str, DataFrame]:
    """``frames``: job_id, shot_id, frame_index, pts_us, height, width, channels, pixels. Returns tables: detections, boxes, attempts, best, frames.

    ``table`` materialises what several steps read: a cache by default, a written table on a cluster.
    """
    ranked = F.row_number().over(Window.partitionBy("job_id", "shot_id").orderBy("frame_index")) - 1
    chunked = frames.withColumn("chunk", F.floor(ranked / o.chunk_frames))
    detections = table(detect(frames))
    shots = frames.groupBy("job_id", "shot_id").agg(F.count("*").alias("frames"))
    boxes = table(removable_boxes(detections, shots, o))
    ready = engines.available(frames.sparkSession)
    made: list[DataFrame] = []

    def evaluate(segments: DataFrame, attempt: int) -> DataFrame:
        plates = table(reconstruct(with_masks(chunked.join(segments, SEGMENT), boxes, o), o))
        routed = decide.route(features(plates, o)).join(segments, SEGMENT)
        routed = routed.withColumn("runs", decide.best_effort(decide.force_route(F.col("force_route"), F.col("route")), F.col("residual_mask_ratio_of_roi")))
        done = table(repaired(plates, decide.engine(routed, ready, "runs"), o)).withColumn("attempt", F.lit(attempt).cast("bigint"))
        made.append(done.join(routed.select(*SEGMENT, F.col("route").alias("decided")), SEGMENT))
        measures = done.select(*SEGMENT, "residual_before", "residual_after", "flicker_ratio", "flicker_p95", "color_delta", "gradient_ratio", "outside_error", "sharpness").distinct()
        return decide.gate(decide.gate_rows(measures, SEGMENT), SEGMENT)

    attempts = table(decide.retry_loop(chunked.select(*SEGMENT).distinct(), SEGMENT, evaluate, o.max_attempts))
    best = decide.best_attempt(attempts, SEGMENT)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    chosen = out.join(best.select(*SEGMENT, "attempt", "passed"), [*SEGMENT, "attempt"])
    final = chosen.select(*SEGMENT, "frame_index", "pts_us", "height", "width", "channels", "pixels", "mask", "output", "route", "decided", "engine", "attempt", "passed")
    return {"detections": detections, "boxes": boxes, "attempts": attempts, "best": best, "frames": window.assemble(final, ["job_id"], ["shot_id", "chunk", "pts_us"])}


def synthetic(spark: SparkSession, jobs: int = 1, **shape) -> DataFrame:
    return synthetic_of(spark.range(jobs), **shape)


def synthetic_of(jobs: DataFrame, frames: int = 12, width: int = 160, height: int = 90) -> DataFrame:
    """Clips with burned-in text, made on the executors: job_id, shot_id, frame_index, pts_us, height, width, channels, pixels, clean, truth."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job in batch.id:
                rows = [(f"clip{job}", 0, i, i * 83_333, height, width, 3, burned.tobytes(), clean.tobytes(), mask.tobytes()) for i, clean, burned, mask in kernels.generate_clip(frames, width, height)]
                yield pd.DataFrame(rows, columns="job_id shot_id frame_index pts_us height width channels pixels clean truth".split())

    return jobs.mapInPandas(make, "job_id string, shot_id long, frame_index long, pts_us long, height int, width int, channels int, pixels binary, clean binary, truth binary")
