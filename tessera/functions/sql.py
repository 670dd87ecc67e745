"""Geometry and media time as SQL functions: SQL-bodied, so Catalyst inlines them and nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "box_area": ("x1 bigint, y1 bigint, x2 bigint, y2 bigint", "bigint", "greatest(0, x2 - x1) * greatest(0, y2 - y1)"),
    "box_intersection": (
        "ax1 bigint, ay1 bigint, ax2 bigint, ay2 bigint, bx1 bigint, by1 bigint, bx2 bigint, by2 bigint",
        "bigint",
        "greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1))",
    ),
    "box_iou": (
        "ax1 bigint, ay1 bigint, ax2 bigint, ay2 bigint, bx1 bigint, by1 bigint, bx2 bigint, by2 bigint",
        "double",
        "coalesce(try_divide(box_intersection(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2), box_area(ax1, ay1, ax2, ay2) + box_area(bx1, by1, bx2, by2) - box_intersection(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2)), 0)",
    ),
    "clip01": ("v double", "double", "greatest(0.0D, least(1.0D, v))"),
    "micros_of_seconds": ("s string", "bigint", "coalesce(cast(bround(try_cast(s as double) * 1000000) as bigint), 0)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session's SQL; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    return list(FUNCTIONS)
