"""Masks as relations: what is removed, how far masks grow, set operations on pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def removable(kind: Column, uncertain: str = "remove") -> Column:
    """Subtitles and overlays, and what is uncertain if the policy is to remove it."""
    return kind.isin("subtitle", "overlay") | ((kind == "uncertain") & F.lit(uncertain == "remove"))


def dilation(height: Column, large: tuple[int, int] = (5, 11), small: tuple[int, int] = (3, 7), from_height: int = 900) -> Column:
    """struct(least, most): limits of a mask's growth in pixels by frame height."""
    pick = lambda i: F.when(height >= from_height, large[i]).otherwise(small[i])
    return F.struct(pick(0).alias("least"), pick(1).alias("most"))


def inpaint_padding(route: Column, height: Column, temporal: int = 72, spatial: int = 64, least: int = 16) -> Column:
    """Pixels around masks that a repair sees, in proportion to the frame's height."""
    base = F.when(route.isin("official_propainter", "sttn_fallback"), temporal).otherwise(spatial)
    return F.greatest(F.lit(least).cast("bigint"), F.bround(base * height / 1080.0).cast("bigint"))


def pixel_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def pixel_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b, key, "left_anti").distinct()


def dilate_square(pixels: DataFrame, frame: list[str], reach: int, width: int, height: int) -> DataFrame:
    """Set pixels and all within ``reach`` rows and columns of one, inside the frame: an offset join along each axis."""
    grown = pixels.select(*frame, "y", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - reach), F.least(F.lit(width - 1), F.col("x") + reach))).alias("x")).distinct()
    return grown.select(*frame, F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - reach), F.least(F.lit(height - 1), F.col("y") + reach))).alias("y"), "x").distinct()


def resize_nearest(pixels: DataFrame, frame: list[str], value: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resizing by integer arithmetic; sizes are (height, width)."""
    (sh, sw), (th, tw) = source, target
    axis = lambda v, s, t: F.filter(F.sequence(F.expr(f"cast({v} * {t} div {s} as bigint)"), F.expr(f"cast(({v} + 1) * {t} div {s} as bigint)")), lambda i: (i < t) & ((i * s / t).cast("bigint") == F.col(v)))
    rows = pixels.select(*frame, value, "x", F.explode(axis("y", sh, th)).alias("_y"))
    return rows.select(*frame, value, F.col("_y").alias("y"), F.explode(axis("x", sw, tw)).alias("x"))


def rectangles(frames: DataFrame, rois: DataFrame, width: int, height: int) -> DataFrame:
    """Every frame with every region of interest, clamped into the frame (regions are a few per job)."""
    from tessera.functions import geometry as g

    b = g.clamp(g.box(), width, height)
    out = frames.crossJoin(F.broadcast(rois)).select(*frames.columns, "roi_id", *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
