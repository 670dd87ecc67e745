"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, features are word shingles
(repeats included), and a bit is set if it is set in over half of the features' XXH64 values. A text of
fewer words than a shingle has one feature, the whole sequence; one of no words (or null) has fingerprint 0
and is linked like any other.

Search: distinct fingerprints only, so copies cost nothing. Correlated bits are put into the same part;
thresholds per part, which must sum to ``distance - parts + 1``, are chosen by dynamic programming over
candidate counts estimated from all fingerprints. Each part with a threshold of 0 or more gives signatures
(the part with each choice of ``threshold`` bits masked); fingerprints that share a signature are candidates.
A small bucket is compared pair by pair. A large bucket is not: there every member is sent to the
centres within half the distance of it, and two fingerprints meet at a centre exactly when their
distance is at most ``distance``. The members at one centre are bounded by the size of that ball, so no group is
ever expanded into all of its pairs and no link is lost.

``neartexts`` is this operator's form for a similarity of texts rather than a number of bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Tables, utf8

BITS = 64
#: A bucket up to this size is compared pair by pair.
PAIRWISE = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_of(data: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text's UTF-8 bytes."""
    words = (data or b"").translate(_LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), seed)
    counts, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = words[at : min(n, at + (1 << 16)) + shingle - 1]
        values = np.array([h(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(shingle)), strict=False)], np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """``docs`` with the column fp, a signed long; a column of that name is replaced, all others pass through. Null counts as the empty text (0)."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(x, shingle, seed) for x in utf8(texts)], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text)))


def _unpacked(fps: pa.Array) -> np.ndarray:
    values = np.ascontiguousarray(fps.to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_products(distinct: DataFrame) -> np.ndarray:
    """Over all fingerprints, how often bits i and j are both set; 64 x 64, the only thing the driver gets."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = _unpacked(batch.column(0)).astype(np.float32)  # exact: a batch has far fewer than 2**24 rows
            total += np.rint(x.T @ x).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for row in distinct.select("fp").mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row.at] = row.n
    return out.reshape(BITS, BITS)


def correlated_parts(products: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in parts of equal width; each part is seeded by the freest most correlated bit and filled with its closest bits."""
    n = max(total, 1)
    p = np.diag(products) / n
    cov = products / n - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS * (k + 1) // parts - BITS * k // parts
        own = [max(free, key=lambda i: (corr[i, free].sum(), -i))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda i: (corr[i, own].sum(), -i)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one for each part and of the given sum, of least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for so_far, (c, chosen) in best.items():
            for t, more in options.items():
                if so_far + t not in new or c + more < new[so_far + t][0]:
                    new[so_far + t] = (c + more, [*chosen, t])
        best = new
    return best[total]


def plan(distinct: DataFrame, total: int, distance: int, parts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """The parts of the cheapest plan with a threshold of 0 or more: (bits, threshold)."""
    products = bit_products(distinct)
    p = np.diag(products) / max(total, 1)
    layouts = {m: correlated_parts(products, total, m) for m in parts if m <= BITS}
    flat = [(m, k, bits) for m, layout in layouts.items() for k, bits in enumerate(layout)]
    masks = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(bits))).alias("value")) for i, (_, _, bits) in enumerate(flat)])
    sizes = distinct.select(F.explode(masks).alias("x")).groupBy("x.part", "x.value").count()
    pairs = {r.part: r.pairs for r in sizes.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m, layout in layouts.items():
        cost = []
        for k, bits in enumerate(layout):
            same = pairs.get(flat.index((m, k, bits)), 0.0)
            ratio = [2 * p[i] * (1 - p[i]) / max(p[i] ** 2 + (1 - p[i]) ** 2, 1e-9) for i in bits]
            # elementary symmetric sums: expected pairs that differ in exactly t bits of the part, for each that differs in none
            e = [1.0] + [0.0] * distance
            for r in ratio:
                for t in range(distance, 0, -1):
                    e[t] += e[t - 1] * r
            cost.append({-1: 0.0} | {t: total * comb(len(bits), t) + same * sum(e[: t + 1]) for t in range(distance + 1)})
        c, chosen = allocate(cost, distance - m + 1)
        if best is None or c < best[0]:
            best = c, [(bits, t) for bits, t in zip(layout, chosen, strict=True) if t >= 0]
    return best[1]


def _signed(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, chosen: list[tuple[list[int], int]], distance: int, tables: Tables) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all pairs within ``distance``."""
    signatures = [(_signed([b for b in bits if b not in out]), k) for bits, t in chosen for k, out in enumerate(combinations(bits, t))]
    probe = F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for i, (mask, _) in enumerate(signatures)])
    probes = distinct.select("fp", F.explode(probe).alias("x")).select("fp", "x.s", "x.v")
    shared = probes.groupBy("s", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = tables.write(probes.join(shared, ["s", "v"]))

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def compared(lists: pa.Array) -> pa.Array:
        out = []
        for members in lists.to_pylist():
            x = np.sort(np.array(members, np.int64))
            u = x.view(np.uint64)  # of signed values NumPy counts the bits of the absolute value
            i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= distance, 1))
            out.append([{"a": int(a), "b": int(b)} for a, b in zip(x[i], x[j], strict=True)])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    small = met.where(F.col("n") <= PAIRWISE).groupBy("s", "v").agg(F.collect_list("fp").alias("members"))
    near = small.select(F.explode(compared("members")).alias("e")).select("e.a", "e.b")
    # Half the distance around each member of a large bucket; an odd distance needs one centre more on one side,
    # so there the centres are taken one wider and what meets is compared.
    crowded = met.where(F.col("n") > PAIRWISE).select("fp").distinct()
    flips = [_signed(list(x)) for r in range((distance + 1) // 2 + 1) for x in combinations(range(BITS), r)]
    centres = crowded.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    groups = centres.groupBy("centre").agg(F.min("fp").alias("low"), F.count("*").alias("n"), F.collect_list("fp").alias("members")).where("n > 1")
    if distance % 2:
        far = groups.select(F.explode(compared("members")).alias("e")).select("e.a", "e.b")
    else:
        far = groups.select(F.col("low").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return tables.write(near.unionByName(far).distinct())


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node reachable.

    Alternating large-star and small-star steps; each is an aggregation and a join on edges, and both
    only ever hold as many edges as there were. Each round is a written table. The rounds are of the order of the squared logarithm of the
    edges, and end when one changes nothing.
    """
    now, seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = tables.write(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct())
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.drop(large)
        if seen is not None:
            tables.drop(now)
        now = small
        if state == seen:
            break
        seen = state
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, fp (signed long), component_id and root, the fingerprint that names the component.

    component_id is the smallest id reachable over fingerprints that differ in ``distance`` bits or fewer.
    Rows may repeat; each gives a row. A null id is never the smallest, and a component of null ids alone has
    component_id null. Null and empty texts have fingerprint 0. An empty table gives none.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = tables.write(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), shingle, seed).select("id", "fp"))
    distinct = tables.write(rows.groupBy("fp").agg(F.min("id").alias("low")))
    total = distinct.count()
    placed = distinct.select("fp", "low", F.col("fp").alias("root"))
    if total > 1:
        edges = links(distinct, plan(distinct, total, distance), distance, tables)
        if not edges.isEmpty():
            roots = tables.write(components(edges, tables))
            placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of = placed.join(placed.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id", "root")
    return rows.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root")

