"""Boxes and polygons as column expressions.

A box is four integer columns x1, y1, x2, y2 (or a struct of them), half-open in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    """The columns ``{prefix}x1{suffix}`` to ``{prefix}y2{suffix}``."""
    return tuple(F.col(f"{prefix}{n}{suffix}") for n in ("x1", "y1", "x2", "y2"))


def fields(struct: Column) -> Box:
    return tuple(struct[n] for n in ("x1", "y1", "x2", "y2"))


def as_struct(b: Box) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


def clamp(b: Box, width: Column | int, height: Column | int) -> Box:
    """Into the frame; the result has x2 >= x1 and y2 >= y1."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    zero = F.lit(0)
    x1, y1 = F.greatest(zero, F.least(w, b[0])), F.greatest(zero, F.least(h, b[1]))
    return x1, y1, F.greatest(x1, F.least(w, b[2])), F.greatest(y1, F.least(h, b[3]))


def expand(b: Box, padding: Column | int, width: Column | int, height: Column | int) -> Box:
    p = F.lit(padding) if isinstance(padding, int) else padding
    return clamp((b[0] - p, b[1] - p, b[2] + p, b[3] + p), width, height)


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is empty."""
    whole = union_area(a, b)
    return F.when(whole > 0, intersection(a, b) / whole).otherwise(0.0)


def overlaps(a: Box, b: Box, least: float) -> Column:
    """IoU of at least ``least``, without a division; false where both are empty."""
    whole = union_area(a, b)
    return (whole > 0) & (intersection(a, b) >= least * whole)


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def polygon_angle(points: Column) -> Column:
    """Degrees of the first edge of an array of (x, y); 0 with fewer than two points."""
    a, b = points[0], points[1]
    return F.when(F.size(points) < 2, 0.0).otherwise(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])))


def polygon_box(points: Column) -> Box:
    """Truncated minima, truncated maxima plus 1."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs).cast("bigint"), F.array_min(ys).cast("bigint"), F.array_max(xs).cast("bigint") + 1, F.array_max(ys).cast("bigint") + 1


def minimum_roi(b: Box, width: int, height: int, least: int = 128) -> Box:
    """Clamped, at least ``least`` on each side, around the same centre and moved to lie inside the frame."""
    x1, y1, x2, y2 = clamp(b, width, height)

    def side(lo: Column, hi: Column, whole: int) -> tuple[Column, Column]:
        size = F.least(F.lit(whole), F.greatest(hi - lo, F.lit(least)))
        first = F.least(F.greatest(F.lit(0), F.bround((lo + hi) / 2 - size / 2).cast("bigint")), whole - size)
        return first, first + size

    (a1, a2), (b1, b2) = side(x1, x2, width), side(y1, y2, height)
    return a1, b1, a2, b2


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def valid_transform(m: list[Column]) -> Column:
    """Nine row-major entries: all finite and 0.15 <= abs(det) <= 6."""
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    finite = F.lit(True)
    for x in m:
        finite = finite & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(finite & F.abs(det).between(0.15, 6.0), F.lit(False))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def uint8(v: Column) -> Column:
    """Truncated into 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), v.cast("bigint")))
