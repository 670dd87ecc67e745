"""SimHash near-duplicates verified on the texts: the form of ``simhash`` for a similarity rather than for a number of bits.

Two texts are linked if their sets of word shingles have a Jaccard similarity of at least ``similarity``. At 0.8 some 15% of
SimHash bits differ, about ten of 64, which is too far for an exact search of one 64-bit fingerprint. So a text
has a long fingerprint, ``WORDS`` independent 64-bit SimHashes, and the pigeonhole is one of chances:

1. Each word's correlated bits are grouped into parts. The chance that two texts of the least similarity differ in at most t bits
   of a part follows from the flip rate, acos(2s / (1 + s)) / pi.
2. Thresholds, unequal and for many parts none at all, are allocated by dynamic programming: the least cost, in probes and
   in candidates estimated from the bits of all fingerprints, at which a pair of the least similarity is met with
   probability ``recall``; more similar pairs are met more often. It runs for several widths of parts, and the cheapest plan is taken.
3. Texts that share a signature (a part with its masked bits) are candidates if ``CHECK`` further words and
   then the whole fingerprint are near enough, and every candidate is verified on its texts' shingles.

Copies (equal words) are one node throughout. A signature of many texts is dealt out to pairs of blocks, so no task gets more than
two blocks of it. Only components are wanted, so crowds of near copies need not be verified pair by pair: a text with up to ``FEW`` candidates
has all of them verified, one with more its nearest, by the whole fingerprint. Further rounds, ``rounds`` in all, each take the next nearest
candidates in other components.

What fingerprints, filters and rounds miss is found by an exact search for the rest (``_rest``), so the components are those of all pairs:

4. Of two texts of at least the similarity, the first few of each one's shingles, in any order of all shingles, share one (the prefix of a set
   join). So a text is listed under these, the rarest first, and texts under one shingle are compared by size and place.
5. Only pairs of different components are verified. A text first takes up to ``FIRST`` partners under a shingle, those of its largest
   component before others; shingles where more are left are asked again for eight times as many, until none is left.
6. Whole sets are made and sent only for pairs that may have the similarity by the counts of their shingles in ``BINS`` bins, and two long texts
   by their prefixes too. Both are bounds: they drop no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Tables, arrow_bytes, utf8
from tessera.llm.simhash import BITS, components, correlated_parts

WORDS, CHECK = 16, 2
#: A signature's texts are compared in blocks of about so many.
BLOCK = 512
#: The cost of one comparison as a share of that of sending a probe.
COMPARISON = 0.01
#: Up to so many candidates of a text are all verified at once.
FEW = 8
#: How surely the filters on fingerprints pass a pair of the least similarity.
PASS = 0.999
#: So many partners of a text under a shingle are verified before components are found anew.
FIRST = 4
#: About so many texts tell which shingles are frequent, those in ``FREQUENT`` of them or more, and so many of these are told apart. They are
#: the last of each text's order: a guess about costs only, as any order finds all pairs.
SAMPLE, FREQUENT, TOLD = 4096, 4, 200_000
#: A set's shingles are counted in so many bins, a byte for each.
BINS, FULL = 256, 255
#: Of sets of more shingles the counts tell little, so pairs of two such are judged by their prefixes too.
LONG = 16 * BINS
#: So many bits tell which texts are asked for, before any is sent. It bounds a broadcast; what passes by chance goes in the join.
MARKS = 1 << 22
#: Rows go to Python in batches of about so many bytes at most, as a pair of long texts' sets alone may have some hundred thousand.
BATCH_BYTES = 1 << 22
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_LOWER).split()


def shingles_of(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, sorted; fewer words than a shingle are one, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    own = np.array([h(w) for w in words], np.uint64)
    n = max(1, len(own) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(own))):
        out = _mixed(out * _ODD + own[i : i + n])
    return np.unique(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


_ADD = _mixed(np.arange(1, WORDS + CHECK + 1, dtype=np.uint64) * _ODD)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """``WORDS + CHECK`` 64-bit SimHashes of a set of shingles."""
    total = np.zeros((WORDS + CHECK) * BITS, np.int64)
    for at in range(0, len(shingles), 255):  # so many that a byte holds their sum
        bits = _mixed(shingles[at : at + 255, None] ^ _ADD[None, :])
        total += np.add.reduce(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles), bitorder="little").view(np.uint64)


def counts_of(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of ``BINS`` bins; ``FULL`` stands for so many or more."""
    return np.minimum(np.bincount((shingles & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8)


def may_be_alike(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Whether sets of these counts, a row for each pair, may have the similarity: in a bin they share the lesser count at most."""
    both, least = np.minimum(a, b).sum(axis=1, dtype=np.int64), np.minimum(*sizes)
    both = np.where((np.minimum(a, b) == FULL).any(axis=1), least, both)
    return both * (1 + similarity) >= similarity * (sizes[0] + sizes[1]) - 1e-6


def key_of(text: Column) -> Column:
    """128 bits that equal texts share, up to white space and the case of A-Z."""

    @F.arrow_udf("binary")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(b" ".join(words_of(x))) for x in utf8(texts)], pa.binary())

    return key(text)


def prefix_length(size: int, similarity: float) -> int:
    """So many shingles of a set, from the start of any common order, hold one of any other set of at least the similarity."""
    return size - ceil(similarity * size - 1e-9) + 1 if size else 0


def prefix_of(shingles: np.ndarray, similarity: float, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first of a set's shingles: the sorted ``known`` ones come last, by ``times``."""
    if len(known) and len(shingles):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        shingles = shingles[np.argsort(np.where(known[at] == shingles, times[at], 0), kind="stable")]
    return shingles[: prefix_length(len(shingles), similarity)]


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles of a sample of different texts, sorted, and in how many of these they occur; at most ``TOLD`` of them."""
    share = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in utf8(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles_of(words_of(data), shingle).view(np.int64))], names=["t"])

    counts = some.mapInArrow(explode, "t long").groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.col("n").desc(), "t").limit(TOLD).toPandas()
    known, times = found["t"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], times[order]


def _sketched(text: Column, shingle: int, similarity: float, frequent) -> Column:
    """key, sketch, number of shingles, their counts and the first of them; ``frequent``: a broadcast of what ``_frequent`` gives."""

    @F.arrow_udf("struct<key:binary,sketch:array<bigint>,size:int,counts:binary,prefix:array<bigint>>")
    def both(texts: pa.Array) -> pa.Array:
        keys, sketches, sizes, counts, prefixes = [], [], [], [], []
        for data in utf8(texts):
            words = words_of(data)
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            shingles = shingles_of(words, shingle)
            sketches.append(sketch_of(shingles).view(np.int64))
            sizes.append(len(shingles))
            counts.append(counts_of(shingles).tobytes())
            prefixes.append(prefix_of(shingles, similarity, *frequent.value).view(np.int64))
        flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (WORDS + CHECK)), pa.array(flat))
        ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes], dtype=np.int64))).astype(np.int32)
        firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), lists, pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()), firsts], names=["key", "sketch", "size", "counts", "prefix"])

    return both(text)


def flip_rate(similarity: float) -> float:
    """The share of bits in which two sets of equal size and this Jaccard similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def within(bits: int, rate: float, most: int) -> float:
    """The chance that at most ``most`` of the bits differ."""
    return min(1.0, sum(comb(bits, t) * rate**t * (1 - rate) ** (bits - t) for t in range(most + 1)))


def limit_of(bits: int, rate: float, chance: float = PASS) -> int:
    """The least number of differing bits that is not exceeded with this chance."""
    return next(t for t in range(bits + 1) if within(bits, rate, t) >= chance)


def bit_products(nodes: DataFrame) -> np.ndarray:
    """For each word, how often bits i and j are both set; (WORDS, 64, 64), all that the driver gets."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS, BITS, BITS), np.int64)
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).flatten().to_numpy(), np.int64).reshape(-1, WORDS + CHECK)[:, :WORDS]
            x = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, WORDS, BITS).astype(np.float32)
            total += np.rint(x.transpose(1, 2, 0) @ x.transpose(1, 0, 2)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "n"])

    out = np.zeros(WORDS * BITS * BITS, np.int64)
    for row in nodes.select("sketch").mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.at] = row.n
    return out.reshape(WORDS, BITS, BITS)


def allocate(options: list[dict[int, tuple[float, float]]], need: float, steps: int = 400) -> tuple[float, list[int]] | None:
    """A threshold for each part, -1 for none, of least cost whose gains add up to ``need``; None if they can't.

    ``options``: for each part, threshold to (cost, gain). Gains are counted in whole steps, rounded down.
    """
    best = np.full(steps + 1, np.inf)
    best[0] = 0.0
    choices = []
    for part in options:
        new, chosen = best.copy(), np.full(steps + 1, -1)
        for t, (cost, gain) in part.items():
            units = min(steps, int(gain / need * steps))
            reached = np.full(steps + 1, np.inf)
            reached[units:] = best[: steps + 1 - units]
            reached[steps] = best[steps - units :].min()
            better = reached + cost < new
            new[better], chosen[better] = (reached + cost)[better], t
        choices.append((best, chosen))
        best = new
    if not np.isfinite(best[steps]):
        return None
    at, out = steps, []
    for part, (before, chosen) in zip(reversed(options), reversed(choices), strict=True):
        t = int(chosen[at])
        out.append(t)
        if t >= 0:
            units = min(steps, int(part[t][1] / need * steps))
            at = steps - units + int(np.argmin(before[steps - units :])) if at == steps else at - units
    return float(best[steps]), out[::-1]


def plan(products: np.ndarray, total: int, similarity: float, recall: float, parts: tuple[int, ...] = (2, 3, 4, 5, 6, 8)) -> list[tuple[int, list[int], int]]:
    """The cheapest plan: (word, bits, threshold) of each part that is probed."""
    rate, need = flip_rate(similarity), -log(1 - recall)
    best = None
    for m in parts:
        layout, options = [], []
        for w in range(WORDS):
            share = np.diag(products[w]) / max(total, 1)
            for bits in correlated_parts(products[w], total, m):
                same = share[bits] ** 2 + (1 - share[bits]) ** 2
                # elementary symmetric sums: the share of pairs that differ in exactly t bits of the part, as that of those that differ in none
                e = [1.0, 0.0, 0.0]
                for r in (1 - same) / np.maximum(same, 1e-9):
                    e[2], e[1] = e[2] + e[1] * r, e[1] + r
                met = [total * total / 2 * float(np.prod(same)) * sum(e[: t + 1]) for t in range(3)]
                layout.append((w, bits))
                options.append({t: (total * comb(len(bits), t) + COMPARISON * met[t], -log(1 - min(within(len(bits), rate, t), 1 - 1e-12))) for t in range(3)})
        found = allocate(options, need)
        if found and (best is None or found[0] < best[0]):
            best = found[0], [(w, bits, t) for (w, bits), t in zip(layout, found[1], strict=True) if t >= 0]
    if best is None:
        raise ValueError(f"{WORDS} words can't reach a recall of {recall}")
    return best[1]


def _signed(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _probes(nodes: DataFrame, chosen: list[tuple[int, list[int], int]], hot: DataFrame | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each node and signature: group, node, check words, cross, side; signatures of ``hot`` in pairs of blocks."""
    masks = [(w, _signed([b for b in bits if b not in out]), out) for w, bits, t in chosen for out in combinations(bits, t)]
    signature = F.array(*[F.xxhash64(F.lit(i), F.col("sketch")[w].bitwiseAND(F.lit(mask))) for i, (w, mask, _) in enumerate(masks)])
    check = [F.col("sketch")[WORDS + i].alias(f"c{i}") for i in range(CHECK)]
    probes = nodes.select("node", *check, *extra, F.explode(signature).alias("k"))
    if hot is None:
        return probes
    block, other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")), F.col("other")
    dealt = probes.join(hot, "k", "left").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    alone = F.col("blocks").isNull()
    group = F.when(alone, F.col("k")).otherwise(F.xxhash64("k", F.least(block, other), F.greatest(block, other)))
    return dealt.select(group.alias("g"), "node", *[f"c{i}" for i in range(CHECK)], F.when(alone, False).otherwise(block != other).alias("cross"), F.when(alone, False).otherwise(block > other).alias("side"), *extra)


def _pairs_in(g: np.ndarray, check: list[np.ndarray], cross: np.ndarray, side: np.ndarray, root: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of rows of one group, i before j, within ``limit``; g is sorted."""
    out, at, step = [], np.arange(len(g)), 1
    while True:
        at = at[: np.searchsorted(at, len(g) - step)]
        at = at[g[at] == g[at + step]]
        if not len(at):
            break
        to = at + step
        d = sum(np.bitwise_count(c[at] ^ c[to]).astype(np.int32) for c in check)
        ok = (d <= limit) & (~cross[at] | (side[at] != side[to]))
        if root is not None:
            ok &= root[at] != root[to]
        out.append((at[ok], to[ok], d[ok]))
        step += 1
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((),) * 3))


def _nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest of one of their members."""
    keep, at = np.zeros(len(i), bool), np.arange(len(i))
    member, pair = np.concatenate((i, j)), np.concatenate((at, at))
    order = np.lexsort((pair, d[pair], member))
    member, pair = member[order], pair[order]
    start = np.flatnonzero(np.concatenate(([True], member[1:] != member[:-1])))
    rank = np.arange(len(member)) - np.repeat(start, np.diff(np.concatenate((start, [len(member)]))))
    keep[pair[rank < most]] = True
    return keep


def _crowded(g: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair's group has over two pairs a member, and those groups."""
    size, of = np.unique(g, return_counts=True)
    at = np.searchsorted(size, g[i])
    many = np.bincount(at, minlength=len(size)) > 2 * of
    return many[at], size[many]


def _candidates(probes: DataFrame, limit: int, again: int = 0) -> DataFrame:
    """(a, b) of candidates, a < b, all of a group's or, in a crowded group, each member's nearest; and (null, null, g) for each crowded group.

    ``again``: only pairs of different roots, and so many nearest of each member, by the longer marks that the probes then carry.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            g, node = (t.column(n).to_numpy() for n in ("g", "node"))
            if again:
                marks = np.ascontiguousarray(t.column("mark").combine_chunks().flatten().to_numpy()).view(np.uint64).reshape(len(g), -1)
                check = list(np.ascontiguousarray(marks.T))
            else:
                check = [t.column(f"c{i}").to_numpy().view(np.uint64) for i in range(CHECK)]
            cross, side = (t.column(n).to_numpy().astype(bool) for n in ("cross", "side"))
            i, j, d = _pairs_in(g, check, cross, side, t.column("root").to_numpy() if again else None, limit)
            more = np.zeros(0, np.int64)
            if len(i):
                if again:
                    keep = _nearest(i, j, d, again)
                else:
                    many, more = _crowded(g, i)
                    keep = ~many
                    at = np.flatnonzero(many)
                    keep[at[_nearest(i[at], j[at], d[at], 1)]] = True
                i, j = i[keep], j[keep]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            gone = pa.nulls(len(more), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a, pa.int64()), gone]), pa.concat_arrays([pa.array(b, pa.int64()), gone]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(more, pa.int64())])], names=["a", "b", "g"])

        left = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if left is None else pa.concat_tables([left, now]).combine_chunks()
            g = now.column("g").to_numpy()
            begin = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            if begin:
                yield found(now.slice(0, begin).combine_chunks())
            left = now.slice(begin)
        if left is not None and len(left):
            yield found(left.combine_chunks())

    return probes.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "a long, b long, g long")


def _measured(pairs: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The pairs whose whole fingerprints differ in at most ``limit`` bits, with that number as d."""
    marks = nodes.select("node", _mark())
    apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = pairs.join(marks.toDF("a", "ma").hint("merge"), "a").join(marks.toDF("b", "mb").hint("merge"), "b")
    return both.select("a", "b", apart.alias("d")).where(F.col("d") <= limit)


def _mark() -> Column:
    return F.array(*[F.col("sketch")[i] for i in range(WORDS)]).alias("mark")


def _hashes(text: Column) -> Column:
    """128 bits of a text as it stands, made without Python."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("i"))


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``: node, named (the hashes of a text of it), from ``docs``: text.

    Most other texts go before the shuffle, by a table of ``MARKS`` bits that the wanted hashes set, and copies meet before it.
    """
    bit, word = F.pmod(F.col("named.h"), F.lit(64)).cast("int"), F.floor(F.pmod(F.col("named.h"), F.lit(MARKS)) / 64).cast("int").alias("word")
    marks = nodes.select(word, F.element_at(F.array(*[F.lit(_signed([k])) for k in range(64)]), bit + 1).alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))
    asked = docs.select(_hashes(F.col("text")).alias("named"), "text").select("named", word, "text").join(F.broadcast(marks), "word").where(F.getbit("marks", bit) == 1)
    return asked.groupBy("named").agg(F.any_value("text").alias("text")).join(nodes, "named").select("node", "text")


def _sets(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of ``nodes``: node, named, from ``docs``: text."""

    @F.arrow_udf("array<bigint>")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([shingles_of(words_of(x), shingle).view(np.int64) for x in utf8(texts)], pa.list_(pa.int64()))

    return _texts(nodes, docs).select("node", shingles("text").alias("shingles"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""

    @F.arrow_udf("double")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        one, other = ((x.offsets.to_numpy(), x.values.to_numpy().view(np.uint64)) for x in (left, right))
        cut = lambda x, k: x[1][x[0][k] : x[0][k + 1]]
        return pa.array([jaccard(cut(one, k), cut(other, k)) for k in range(len(left))], pa.float64())

    joined = pairs.join(sets.toDF("a", "sa").hint("merge"), "a").join(sets.toDF("b", "sb").hint("merge"), "b")
    return joined.select("a", "b", alike("sa", "sb").alias("s")).where(F.col("s") >= similarity).select("a", "b")


def _next(open_: DataFrame) -> DataFrame:
    """Of the pairs (a, b, d) each node's nearest, and all of a node with up to ``FEW``."""
    ends = open_.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "d", F.col("b").alias("other")), F.struct(F.col("b").alias("node"), "d", F.col("a").alias("other")))).alias("e")).select("e.*")
    by = ends.groupBy("node").agg(F.min(F.struct("d", "other")).alias("best"), F.count("*").alias("n"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    nearest = by.select(*pair(F.col("node"), F.col("best.other")))
    few = ends.join(by.where(F.col("n") <= FEW).select("node"), "node", "left_semi").select(*pair(F.col("node"), F.col("other")))
    return nearest.unionByName(few).distinct()


def _links(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, recall: float, rounds: int, total: int) -> DataFrame | None:
    """(node, root) of every node that is linked to another; None without any."""
    tables = Tables(nodes.sparkSession)
    rate = flip_rate(similarity)
    chosen, limit = plan(bit_products(nodes), total, similarity, recall), limit_of(WORDS * BITS, rate)
    hot = tables.write(_probes(nodes, chosen, None).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("k", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")))
    met = tables.write(_candidates(_probes(nodes, chosen, hot), limit_of(CHECK * BITS, rate)))
    pool = tables.write(_measured(met.where("a is not null").select("a", "b").distinct(), nodes, limit))
    crowds = tables.write(met.where("g is not null").select("g").distinct())
    tables.drop(met)
    crowd = None if crowds.isEmpty() else tables.write(_probes(nodes.select("node", "sketch", _mark()), chosen, hot, ("mark",)).drop(*[f"c{i}" for i in range(CHECK)]).join(crowds, "g", "left_semi"))
    wanted = pool.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = (wanted if crowd is None else wanted.unionByName(crowd.select("node"))).distinct()
    sets = tables.write(_sets(tables.write(nodes.select("node", "named").join(wanted, "node", "left_semi")), docs, shingle))
    edges = roots = tried = None
    for number in range(1, rounds + 1):
        open_ = pool
        if number > 1:
            now = nodes.select("node", F.col("node").alias("root")) if roots is None else roots
            root = lambda n: (now.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")), n, "left")
            if crowd is not None:
                rooted = crowd.join(now, "node", "left").withColumn("root", F.coalesce("root", "node"))
                more = _measured(_candidates(rooted, limit, again=number).select("a", "b").distinct(), nodes, limit)
                pool = tables.write(pool.unionByName(more).distinct())
            open_ = pool.join(*root("a")).join(*root("b")).where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "d").join(tried, ["a", "b"], "left_anti")
        picked = tables.write(_next(open_))
        found = tables.write(_alike(picked, sets, similarity))
        tried = picked if tried is None else tables.write(tried.unionByName(picked))
        if not found.isEmpty():
            edges = tables.write(found if edges is None else edges.unionByName(found))
            roots = tables.write(components(edges, tables))
        elif number > 1 or crowd is None:  # the first round has not asked the crowds yet
            break
    tables.clear(roots)
    return roots


def _partners(token: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float, most: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, tokens): rows of one token and different roots that may be similar, up to ``most`` of each i, and the tokens where some are left.

    ``token`` is sorted. A token's most frequent root comes last in its group and first among partners; pairs inside it are not looked at.
    """
    none = np.zeros(0, np.int64)
    pairs = np.lexsort((root, token))
    new = np.concatenate(([True], (token[pairs][1:] != token[pairs][:-1]) | (root[pairs][1:] != root[pairs][:-1]))) if len(pairs) else none
    run = np.empty(len(pairs), np.int64)
    run[pairs] = np.cumsum(new) - 1
    count = np.bincount(run)[run] if len(pairs) else none
    order = np.lexsort((root, count, token))
    group = np.flatnonzero(np.concatenate(([True], token[order][1:] != token[order][:-1]))) if len(order) else none
    end = np.repeat(np.append(group[1:], len(order)), np.diff(np.append(group, len(order)))) if len(order) else none
    last = root[order[end - 1]] if len(order) else none
    first = np.flatnonzero(root[order] != last)  # rows of the last root have no later row of another root
    many = end[first] - first - 1
    out, left, at = [], [], 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), step, "right")) + at)
        a = np.repeat(first[at:stop], many[at:stop])
        begin = np.cumsum(many[at:stop]) - many[at:stop]
        b = np.repeat(end[first[at:stop]] - 1, many[at:stop]) - (np.arange(len(a)) - np.repeat(begin, many[at:stop]))
        x, y = order[a], order[b]
        both = np.minimum(size[x] - place[x], size[y] - place[y])  # what may be shared from here on
        ok = (root[x] != root[y]) & (both * (1 + similarity) >= similarity * (size[x] + size[y]) - 1e-6)
        x, y, a = x[ok], y[ok], a[ok]
        if len(a):
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
            out.append((x[rank < most], y[rank < most]))
            left.append(np.unique(token[x[rank >= most]]))
        at = stop
    if not out:
        return none, none, none
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.unique(np.concatenate(left))


def _met(listed: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b) that ``_partners`` finds among ``listed``: token, node, root, size, place; and (null, null, token) for tokens where some are left."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            token, node, root, size, place = (t.column(n).to_numpy() for n in ("token", "node", "root", "size", "place"))
            i, j, more = _partners(token, root, size.astype(np.int64), place.astype(np.int64), similarity, most)
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(len(more), pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(more), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(more, pa.int64())])], names=["a", "b", "token"])

        left = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if left is None else pa.concat_tables([left, now])
            token = now.column("token").to_numpy()
            begin = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last group may go on
            if begin:
                yield found(now.slice(0, begin))
            left = now.slice(begin)
        if left is not None and len(left):
            yield found(left)

    return listed.repartition("token").sortWithinPartitions("token").mapInArrow(compare, "a long, b long, token long")


def most_shared(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, sizes: tuple[int, int]) -> int:
    """At most so many shingles two sets share, by their prefixes: those up to the sooner end, in the common order of (rank, value), and all that comes after."""
    if (rx[-1], x[-1]) > (ry[-1], y[-1]):
        return most_shared(y, x, ry, rx, sizes[::-1])
    n = int(np.count_nonzero((ry < rx[-1]) | ((ry == rx[-1]) & (y <= x[-1]))))
    return len(np.intersect1d(x, y[:n], assume_unique=True)) + min(sizes[0] - len(x), sizes[1] - n)


def _counted(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that may have the similarity by their counts, and whether both are long; false ones go before whole sets are made and sent."""

    @F.arrow_udf("boolean")
    def may(left: pa.Array, right: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
        one, other = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, BINS) for x in (left, right))
        return pa.array(may_be_alike(one, other, (sa.to_numpy().astype(np.int64), sb.to_numpy().astype(np.int64)), similarity), pa.bool_())

    light = nodes.select("node", "counts", "size")
    joined = pairs.join(light.toDF("a", "ca", "sa").hint("merge"), "a").join(light.toDF("b", "cb", "sb").hint("merge"), "b")
    return joined.select("a", "b", (F.least("sa", "sb") > LONG).alias("long"), may("ca", "cb", "sa", "sb").alias("ok")).where("ok").select("a", "b", "long")


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float, frequent) -> DataFrame:
    """The pairs (a, b) that may have the similarity by what their prefixes share."""

    @F.arrow_udf("boolean")
    def possible(left: pa.Array, right: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
        known, times = frequent.value

        def parts(lists):
            values = lists.values.to_numpy().view(np.uint64)
            if not len(known):
                return lists.offsets.to_numpy(), values, np.zeros(len(values), np.int64)
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            return lists.offsets.to_numpy(), values, np.where(known[at] == values, times[at], 0)

        (lo, lv, lr), (ro, rv, rr), out = parts(left), parts(right), []
        for k, (m, n) in enumerate(zip(sa.to_pylist(), sb.to_pylist(), strict=True)):
            i, j = slice(lo[k], lo[k + 1]), slice(ro[k], ro[k + 1])
            out.append(most_shared(lv[i], rv[j], lr[i], rr[j], (m, n)) * (1 + similarity) >= similarity * (m + n) - 1e-6)
        return pa.array(out, pa.bool_())

    light = nodes.select("node", "prefix", "size")
    joined = pairs.join(light.toDF("a", "pa", "sa").hint("merge"), "a").join(light.toDF("b", "pb", "sb").hint("merge"), "b")
    return joined.select("a", "b", possible("pa", "pb", "sa", "sb").alias("ok")).where("ok").select("a", "b")


def _rest(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, roots: DataFrame | None, frequent) -> DataFrame | None:
    """``roots`` (node, root) made whole: the components of all pairs of at least the similarity; None without any."""
    tables = Tables(nodes.sparkSession)
    edges = None if roots is None else roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    tried = asked = None
    most, first, places = FIRST, roots, nodes.select("node", "size", "prefix")
    while True:
        if asked is not None:  # only texts under shingles that are asked again, and only these shingles of theirs
            left = places.select("node", "size", F.posexplode("prefix").alias("place", "token")) if most == 8 * FIRST else places
            places = tables.write(left.join(asked, "token", "left_semi"))
        listed = places if roots is None else places.join(roots, "node", "left")
        root = F.col("node").alias("root") if roots is None else F.coalesce("root", "node").alias("root")
        listed = listed.select("node", root, "size", *([F.posexplode("prefix").alias("place", "token")] if asked is None else ["place", "token"]))
        met = tables.write(_met(listed, similarity, most))
        pairs = met.where("a is not null").select("a", "b").distinct()
        pairs = tables.write(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        asked = tables.write(met.where("token is not null").select("token").distinct())
        tables.drop(met)
        tried = pairs if tried is None else tables.write(tried.unionByName(pairs))
        counted = tables.write(_counted(pairs, nodes, similarity))
        pairs, long = (counted.where(x).select("a", "b") for x in ("not long", "long"))
        if not long.isEmpty():
            pairs = tables.write(pairs.unionByName(_possible(long, nodes.where(F.col("size") > LONG), similarity, frequent)))
        if not pairs.isEmpty():
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            named = tables.write(nodes.select("node", "named").join(wanted, "node", "left_semi"))
            sets = tables.write(_sets(named, docs, shingle))
            found = tables.write(_alike(pairs, sets, similarity))
            tables.drop(sets)
            if not found.isEmpty():
                edges = tables.write(found if edges is None else edges.unionByName(found))
                roots = tables.write(components(edges, tables))
        if asked.isEmpty():
            break
        most *= 8
    tables.clear(*([] if roots is first else [roots]))
    return roots


def near_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.5, rounds: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, key (of its words), component_id, root, the node that names the component.

    component_id is the smallest id reachable over pairs of at least the similarity, all of them and no others. ``recall`` and ``rounds`` only say how
    many of the links fingerprints are to find before the exact search for the rest: they change the cost, not the result. Rows may repeat; each gives a row. A null id is
    never the smallest, and a component of null ids alone has component_id null. Null and empty texts have no words: they are
    copies of each other and near nothing else. Texts of any length are read whole. An empty table gives no rows.
    """
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        found = _placed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), shingle, similarity, recall, rounds)
    return found.select(F.col("id").alias(id_col), "key", "component_id", "root")


def _placed(light: DataFrame, shingle: int, similarity: float, recall: float, rounds: int) -> DataFrame:
    """What ``near_texts`` gives for ``light``: id, text. No Python is left in it to run."""
    spark = light.sparkSession
    tables = Tables(spark)
    frequent = spark.sparkContext.broadcast(_frequent(light, shingle))
    made = tables.write(light.select("id", _hashes(F.col("text")).alias("named"), _sketched(F.col("text"), shingle, similarity, frequent).alias("x")).select("id", "named", "x.*"))
    rows = made.select("id", "key")
    distinct = made.groupBy("key").agg(F.min("id").alias("low"), F.min("named").alias("named"), *[F.any_value(c).alias(c) for c in ("sketch", "size", "counts", "prefix")])
    seed = 0
    while True:  # nodes are told apart by 64 bits; in the rare case that two share them, by others
        nodes = tables.write(distinct.select("key", "sketch", "low", "named", "size", "counts", "prefix", F.xxhash64("key", F.lit(seed)).alias("node")))
        total, told = nodes.agg(F.count("*"), F.count_distinct("node")).first()
        if total == told:
            break
        tables.drop(nodes)
        seed += 1
    placed = nodes.select("key", "low", F.col("node").alias("root"))
    roots = _rest(nodes, light, shingle, similarity, _links(nodes, light, shingle, similarity, recall, rounds, total), frequent) if total > 1 else None
    if roots is not None:
        placed = nodes.join(roots, "node", "left").select("key", "low", F.coalesce("root", "node").alias("root"))
    placed = tables.write(placed)
    of = placed.join(placed.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("key", "component_id", "root")
    return rows.join(of, "key").select("id", "key", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, with all of its columns: the one of the smallest id.

    Where that id occurs in several rows, or all ids are null, it is the row that compares smallest as a whole.
    """
    tables = Tables(docs.sparkSession)
    found = tables.write(near_texts(docs, id_col=id_col, text=text, **options))
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    counts = kept.agg(F.count("*").alias("rows"), F.count_distinct("root").alias("groups"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    ids = tables.write(kept.select(F.col(id_col).alias("_kept_id"), F.col("key").alias("_kept_key"), F.col("root").alias("_kept_root")).distinct())
    out = docs.join(ids.hint("merge"), docs[id_col].eqNullSafe(ids["_kept_id"]), "left_semi")
    if counts.rows != counts.groups or counts.nulls:  # rare: ids that repeat or are null
        packed = out.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), key_of(F.col(text)).alias("_key"))
        placed = packed.join(ids, (packed["_key"] == ids["_kept_key"]) & packed[f"_row.{id_col}"].eqNullSafe(ids["_kept_id"]))
        out = placed.groupBy("_kept_root").agg(F.min("_row").alias("_row")).select("_row.*")
    return out.select(*docs.columns)
