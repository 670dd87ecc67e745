"""Media time, rational numbers, names and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def rational(text: Column, default: tuple[int, int] | None = None) -> Column:
    """``n/d`` or ``n`` as struct<num,den>; the default (or null) for null, N/A, no number and a zero denominator."""
    parts = F.split(text, "/")
    num = F.try_element_at(parts, F.lit(1)).try_cast("bigint")
    den = F.when(F.size(parts) == 1, F.lit(1).cast("bigint")).when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)).try_cast("bigint"))
    value = F.when(num.isNotNull() & (den != 0), F.struct(num.alias("num"), den.alias("den")))
    if default is None:
        return value
    return F.coalesce(value, F.struct(F.lit(default[0]).cast("bigint").alias("num"), F.lit(default[1]).cast("bigint").alias("den")))


def ratio(r: Column) -> Column:
    return F.coalesce(r["num"] / r["den"], F.lit(0.0))


def seconds_to_us(text: Column) -> Column:
    """Half-even micros of a number of seconds; 0 for anything else."""
    return F.coalesce(F.bround(text.try_cast("double") * MICROS).try_cast("bigint"), F.lit(0).cast("bigint"))


def pts_to_us(pts: Column, num: Column, den: Column, fallback: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(pts * num, den) * MICROS).cast("bigint"), fallback)


def rotation(tag: Column, side_data: Column) -> Column:
    """Degrees 0..359 from the tag (truncated), else from the first readable side datum (half-even), else 0."""
    readable = F.filter(F.transform(side_data, lambda x: F.bround(x.try_cast("double"))), lambda x: x.isNotNull())
    return F.pmod(F.coalesce(tag.try_cast("double").cast("bigint"), F.try_element_at(readable, F.lit(1)).cast("bigint"), F.lit(0).cast("bigint")), F.lit(360).cast("bigint"))


def clock(us: Column) -> Column:
    """HH:MM:SS.mmm, half-even"""
    hours, minutes = F.expr("0") + F.floor(us / (3600 * MICROS)), F.floor(us / (60 * MICROS)) % 60
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, F.bround((us % (60 * MICROS)) / 1000.0) / 1000.0)


def canonical_json_hash(*pairs: tuple[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys; values are strings, numbers and booleans that are never null."""
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(pairs, key=lambda p: p[0])]), F.lit("}"))
    return F.sha2(body.cast("binary"), 256)


def quoted(text: Column) -> Column:
    """A JSON string of text without control characters."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def fast_hash(size: Column, mtime_us: Column, content: Column, edge: int = 1 << 20) -> Column:
    """Of the size, the time and the first and last ``edge`` bytes; the last ones only of longer content."""
    tail = F.when(size > edge, F.substring(content, -edge, edge)).otherwise(F.lit(b""))
    return F.sha2(F.concat(size.cast("string").cast("binary"), mtime_us.cast("string").cast("binary"), F.substring(content, 1, edge), tail), 256)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")


def roi(text: Column) -> Column:
    """``x1,y1,x2,y2`` as an array of four longs; null unless 0 <= x1 < x2 and 0 <= y1 < y2."""
    v = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("bigint"))
    ok = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull())
    ok = ok & (F.try_element_at(v, F.lit(1)) >= 0) & (F.try_element_at(v, F.lit(2)) >= 0)
    ok = ok & (F.try_element_at(v, F.lit(3)) > F.try_element_at(v, F.lit(1))) & (F.try_element_at(v, F.lit(4)) > F.try_element_at(v, F.lit(2)))
    return F.when(ok, v)


def under_root(path: Column, roots: list[str]) -> Column:
    """Whether the path is one of the roots or lies below one; no roots allow any path."""
    if not roots:
        return F.lit(True)
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out & ~path.rlike(r"(^|/)\.\.(/|$)")


def container_family(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(".mp4", ".m4v", ".mov"), "mp4").when(suffix == ".webm", "webm").otherwise("matroska")


def normal_codec(codec: Column, family: Column, configured: str = "auto") -> Column:
    """h264, h265 or av1; null for anything else. WebM has av1 only."""
    asked = F.lit(configured) if configured != "auto" else codec
    chosen = F.when(asked == "auto", F.when(family == "webm", "av1").otherwise("h264")).otherwise(asked)
    chosen = F.when((family == "webm") & chosen.isin("h264", "h265"), "av1").otherwise(chosen)
    return F.when(chosen.isin("h264", "h265", "av1"), chosen)


def vram_mb(pixels: Column, frames: Column, fp16: Column) -> Column:
    """Predicted memory of the temporal model, half-even."""
    mb = 900 + 0.00027 * pixels * frames + 0.0025 * pixels + 4e-9 * pixels * pixels
    return F.bround(F.when(fp16, mb).otherwise(mb * 1.45)).cast("bigint")
