"""Order MinHash fingerprints of whole texts.

Each of ``rows`` hash functions selects the ``tuple_size`` smallest of a text's occurrence-numbered k-mers
(the k code points and how many times they occurred before), puts these back into text order and hashes the
tuple. Two fingerprints' likeness is the share of equal tuple hashes; unlike a plain MinHash it falls when
k-mers move, so it follows edit distance.

A text of fewer code points than k is one k-mer; one of fewer k-mers than a tuple gives the tuple of all. The empty text (and null) has
the fingerprint of zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import MAX_BLOCKS, Tables, block_of, utf8

K, TUPLE, ROWS = 6, 2, 32
#: Positions that are hashed at a time; bounds memory for very long texts.
BLOCK = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def _multipliers(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = (_mixed(np.arange(1, 2 * rows + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)
    return base[:rows, None] | np.uint32(1), base[rows:, None]


def numbered_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-mer with the number of its earlier occurrences, in text order."""
    n = max(1, len(codes) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(codes))):
        h = (h + codes[i : i + n].astype(np.uint64) + np.uint64(1)) * _MIX
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if new.all():
        return h
    place = np.arange(n)
    number = np.empty(n, np.uint64)
    number[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return np.where(number > 0, _mixed(h + number * _ODD), h)


def _mers(text: str, k: int) -> np.ndarray:
    return numbered_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k)


State = tuple[np.ndarray, np.ndarray]


def _select(mers: np.ndarray, first: int, stop: int, take: int, rows: int, seed: int, state: State | None = None) -> State:
    """Each row's ``take`` smallest values and their places, of those in ``state`` and of the places from ``first`` to ``stop``.

    Values are 32-bit permutations of the k-mer hashes' upper halves; of equal ones the earlier place counts.
    """
    a, b = _multipliers(rows, seed)
    least, at = state or (np.empty((rows, 0), np.uint32), np.empty((rows, 0), np.int64))
    for begin in range(first, stop, BLOCK):
        h = (mers[begin : min(stop, begin + BLOCK)] >> np.uint64(32)).astype(np.uint32)[None, :] * a
        h ^= h >> np.uint32(15)
        h += b
        for _ in range(min(take, h.shape[1])):
            i = h.argmin(axis=1)[:, None]
            least = np.concatenate((least, np.take_along_axis(h, i, 1)), axis=1)
            at = np.concatenate((at, i + begin), axis=1)
            np.put_along_axis(h, i, np.uint32(0xFFFFFFFF), 1)
        if least.shape[1] > take:
            best = np.argsort(least, axis=1, kind="stable")[:, :take]
            least, at = np.take_along_axis(least, best, 1), np.take_along_axis(at, best, 1)
    return least, at


def _tuples(mers: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    chosen = mers[np.sort(at, axis=1)]
    out = np.full(rows, np.uint64(at.shape[1]))
    for i in range(at.shape[1]):
        out = _mixed(out * _ODD + chosen[:, i])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def fingerprint(text: str, k: int = K, tuple_size: int = TUPLE, rows: int = ROWS, seed: int = 7) -> np.ndarray:
    """``rows`` 32-bit tuple hashes."""
    if not text:
        return np.zeros(rows, np.uint32)
    mers = _mers(text, k)
    _, at = _select(mers, 0, len(mers), min(tuple_size, len(mers)), rows, seed)
    return _tuples(mers, at, rows)


def fingerprint_pair(text: str, changed: str, same: int, k: int = K, tuple_size: int = TUPLE, rows: int = ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Both texts' fingerprints; they share their first ``same`` code points, which are hashed once."""
    shared = same - k + 1
    if shared < tuple_size:
        return tuple(fingerprint(x, k, tuple_size, rows, seed) for x in (text, changed))
    a, b = _mers(text, k), _mers(changed, k)
    state = _select(a, 0, shared, tuple_size, rows, seed)
    return tuple(_tuples(m, _select(m, shared, len(m), tuple_size, rows, seed, state)[1], rows) for m in (a, b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def compare_in_order(docs: DataFrame, rows_per_block: int = 2048, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Each document's fingerprint, its edited text's and the next document's, ids ascending and the first after the last.

    Rows: id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next. Null
    ids come first; rows of one id follow each other in order of their texts; null texts are empty. The only
    document of a table follows itself.

    Documents are dealt out to blocks of consecutive ids; the first document of each block goes to the block
    before as well, so every block has all it needs and is one pass over its rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    base = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = base.count()
    blocks = min(MAX_BLOCKS, max(1, -(-total // rows_per_block)))
    keys = tables.write(base.select("key"))
    if total:
        # about even blocks; their exact bounds don't matter to the result
        cuts = sorted(set(keys.agg(F.approx_percentile("key", [i / blocks for i in range(1, blocks)] or [0.5], 10 * blocks)).first()[0])) if blocks > 1 else []
    else:
        cuts = []
    bounds = spark.createDataFrame([(cuts,)], "cuts array<bigint>")
    placed = block_of(F.col("cuts"), len(cuts), F.col("key"), below=True)
    dealt = base.crossJoin(F.broadcast(bounds)).withColumn("block", placed).drop("cuts")
    heads = keys.crossJoin(F.broadcast(bounds)).withColumn("block", placed).groupBy("block").agg(F.min("key").alias("head"))
    heads = [(r.block, r.head) for r in heads.orderBy("block").collect()]  # one for each block
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    extra = spark.createDataFrame([(k, b) for k, b in before.items()], "key bigint, to int")
    copies = dealt.join(F.broadcast(extra), "key").select("id", "key", "text", F.col("to").alias("block"), F.lit(True).alias("head"))
    every = dealt.select("id", "key", "text", "block", F.lit(False).alias("head")).unionByName(copies)
    ordered = every.repartition(max(1, len(heads)), "block").sortWithinPartitions("block", "head", "key", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting: list = []  # the rows whose next row has come, each as (id, text, next text); then the last row
        last = None  # (id, text, block, head)
        for batch in batches:
            ids, blocks_, heads_ = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, data in enumerate(utf8(batch.column(1))):
                if last is not None and last[3] and last[2] == blocks_[i]:
                    continue  # only the first of the next block's rows is wanted
                body = data.decode("utf-8", "replace")
                if last is not None and not last[3]:
                    waiting.append((last[0], last[1], body))
                if heads_[i]:
                    out += _rows(waiting, options)
                    waiting = []
                elif len(waiting) >= 64:
                    out += _rows(waiting[:-1], options)
                    waiting = waiting[-1:]
                last = (ids[i], body, blocks_[i], heads_[i])
                if len(out) >= 512:
                    yield _batch(out)
                    out = []
        out += _rows(waiting, options)
        if out:
            yield _batch(out)

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kind = _schema(docs.schema[id_col].dataType, id_col)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)

    return ordered.select("id", "text", "block", "head").mapInArrow(walk, schema)


def _schema(id_type, id_col: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(id_col, to_arrow_type(id_type)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(run: list[tuple], options: dict) -> list[tuple]:
    """Results for consecutive documents (id, text, next text); each next text but the last is the text that follows."""
    out, mark = [], None
    pairs = []
    for _, body, after in run:
        changed = edited(body, after)
        if changed == body:
            own = fingerprint(body, **options)
            pairs.append((own, own, changed))
        else:
            pairs.append((*fingerprint_pair(body, changed, len(body) - len(body) // 4, **options), changed))
    for i, (id_, body, after) in enumerate(run):
        mark, changed_mark, changed = pairs[i]
        after_mark = pairs[i + 1][0] if i + 1 < len(run) else fingerprint(after, **options)
        digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
        out.append((id_, len(body), digest, mark.astype(">u4").tobytes().hex(), changed_mark.astype(">u4").tobytes().hex(), likeness(mark, changed_mark), likeness(mark, after_mark)))
    return out
