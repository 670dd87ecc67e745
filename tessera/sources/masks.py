"""External masks: names, manifests, resolution, digests, rasters and archives."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_token(name: Column) -> Column:
    """struct(kind, number) of a file name: ``N``, ``frame_N`` and ``mask_N`` are frames, ``pts_N`` times, in any case; null fields otherwise."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    number = F.regexp_extract(stem, r"^(?:frame_|mask_|pts_)?(\d+)$", 1)
    kind = F.when(number == "", F.lit(None)).when(stem.startswith("pts_"), "pts").otherwise("frame")
    return F.struct(kind.cast("string").alias("kind"), F.when(number != "", number).try_cast("bigint").alias("number"))


def manifest_entries(manifests: DataFrame, json_col: str) -> DataFrame:
    """kind, number, path of both manifest forms, with the other columns: ``frames`` as a mapping or as a list, or a mapping at the top."""
    keep = [c for c in manifests.columns if c != json_col]
    listed = F.from_json(F.get_json_object(json_col, "$.frames"), "array<struct<frame_index:bigint,pts_us:bigint,path:string>>")
    is_list = F.get_json_object(json_col, "$.frames").startswith("[")
    items = manifests.where(is_list).select(*keep, F.explode(listed).alias("e")).where("e.path is not null")
    pair = F.array(F.struct(F.lit("frame").alias("kind"), F.col("e.frame_index").alias("number")), F.struct(F.lit("pts").alias("kind"), F.col("e.pts_us").alias("number")))
    from_list = items.select(*keep, F.col("e.path").alias("path"), F.explode(pair).alias("k")).where("k.number is not null").select(*keep, "k.kind", "k.number", "path")
    body = F.coalesce(F.get_json_object(json_col, "$.frames"), F.col(json_col))
    mapped = manifests.where(~F.coalesce(is_list, F.lit(False))).select(*keep, F.explode(F.from_json(body, "map<string,string>")).alias("k", "path")).where("path is not null")
    key = F.lower("k")
    number = F.regexp_extract(key, r"^(?:pts_|frame_)?(\d+)$", 1)
    from_map = mapped.where(number != "").select(*keep, F.when(key.startswith("pts_"), "pts").otherwise("frame").alias("kind"), number.cast("bigint").alias("number"), "path")
    return from_list.unionByName(from_map)


def resolve_sources(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: a manifest's before a name's, then the first by ``order``."""
    rank = F.struct(F.when(F.col("source") == "manifest", 0).otherwise(1), F.col(order))
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*key, "r.*")


def set_digest(files: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """SHA-256 of the compact JSON list of relative path, hash and size, ordered by path; lists hold a few bytes for each file."""
    entry = F.concat(F.lit('{"relative":"'), "path", F.lit('","sha256":"'), F.sha2(content, 256), F.lit('","size":'), F.octet_length(content).cast("string"), F.lit("}"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("path"), entry.alias("e"))))
    body = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["e"]), ","), F.lit("]"))
    return files.groupBy(*key).agg(F.sha2(body.cast("binary"), 256).alias("digest"))


def binarize(raw: np.ndarray) -> np.ndarray:
    """0 or 255 of a raster: gray, or the larger of gray and alpha, above 0.05 if values are at most 1, else above 8."""
    if raw.ndim == 3:
        blue, green, red = (raw[..., i].astype(np.float64) for i in range(3))
        gray = 0.114 * blue + 0.587 * green + 0.299 * red
        raw = np.maximum(gray, raw[..., 3]) if raw.shape[2] == 4 else gray
    top = float(np.nanmax(raw)) if raw.size else 0.0
    return np.where(raw > (0.05 if top <= 1.0 else 8.0), 255, 0).astype(np.uint8)


def read_rasters(files: DataFrame) -> DataFrame:
    """Rasters (path, content) in NumPy's format or as PNG: path, height, width and a binary plane ``mask``."""
    from tessera.operators.kernels import read_png

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            planes = [binarize(np.load(io.BytesIO(x), allow_pickle=False) if p.lower().endswith(".npy") else read_png(bytes(x))) for p, x in zip(batch.path, batch.content, strict=True)]
            yield pd.DataFrame({"path": batch.path, "height": [p.shape[0] for p in planes], "width": [p.shape[1] for p in planes], "mask": [p.tobytes() for p in planes]})

    return files.select("path", "content").mapInPandas(decode, "path string, height int, width int, mask binary")


def export_archive(masks: list[tuple[int, int, np.ndarray]]) -> bytes:
    """An NPZ archive of (frame_index, pts_us, plane) with its JSON metadata."""
    out = io.BytesIO()
    meta = [{"frame_index": i, "pts_us": p, "key": f"mask_{n:06d}"} for n, (i, p, _) in enumerate(masks)]
    np.savez_compressed(out, metadata=np.frombuffer(json.dumps(meta, sort_keys=True).encode(), np.uint8), **{f"mask_{n:06d}": m for n, (_, _, m) in enumerate(masks)})
    return out.getvalue()


def import_archive(files: DataFrame) -> DataFrame:
    """Archives (path, content) as a row for each mask: path, frame_index, pts_us, height, width, mask."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    rows = [(path, x["frame_index"], x["pts_us"], *z[x["key"]].shape, z[x["key"]].astype(np.uint8).tobytes()) for x in json.loads(bytes(z["metadata"]))]
                yield pd.DataFrame(rows, columns=["path", "frame_index", "pts_us", "height", "width", "mask"])

    return files.select("path", "content").mapInPandas(decode, "path string, frame_index long, pts_us long, height int, width int, mask binary")
