import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as s
from tessera.llm._shared import Tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, distance):
    at = {f: f for f in fps}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    fs = list(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= distance:
                at[find(a)] = find(b)
    return {f: find(f) for f in fs}


def check(rows, texts):
    fps = {f for _, f, *_ in rows}
    roots = brute_components([f & (1 << 64) - 1 for f in fps], 2)
    low = {}
    for i, f, *_ in rows:
        r = roots[f & (1 << 64) - 1]
        if i is not None:
            low[r] = min(i, low.get(r, i))
    assert all(c == low.get(roots[f & (1 << 64) - 1]) for _, f, c, *_ in rows)
    assert sorted(f & (1 << 64) - 1 for _, f, *_ in rows) == sorted(map(brute_fp, texts))


def test_edge_rows(edge, empty):
    rows = [tuple(r) for r in s.near_duplicates(edge).collect()]
    check(rows, [r.text for r in edge.collect()])
    assert s.near_duplicates(empty).count() == 0


def test_documents(docs):
    check([tuple(r) for r in s.near_duplicates(docs).collect()], [r.text for r in docs.collect()])


def planted(seed, n):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, n)]
    for base in out[:3]:  # crowded groups, larger than is compared pair by pair, and chains
        out += [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (150, 2))]
    chain = out[3]
    for b in range(12):
        chain ^= 3 << 4 * b
        out.append(chain)
    return sorted({x - (1 << 64) if x >> 63 else x for x in out})


def test_links_are_whole(spark):
    for distance in (1, 2, 3):
        fps = planted(distance, 400)
        distinct = spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "fp long, low long")
        tables = Tables(spark)
        chosen = s.plan(distinct, len(fps), distance)
        assert sum(t + 1 for _, t in chosen) == distance + 1
        edges = s.links(distinct, chosen, distance, tables)
        unsigned = lambda x: x & (1 << 64) - 1
        want = brute_components([unsigned(x) for x in fps], distance)
        got = {r.node: r.root for r in s.components(edges, tables).collect()}
        assert all((unsigned(e.a) ^ unsigned(e.b)).bit_count() <= max(distance, 2) for e in edges.limit(2000).collect())
        group = lambda f: got.get(f, f)
        assert len({(want[unsigned(f)], group(f)) for f in fps}) == len(set(want.values())) == len({group(f) for f in fps})


def test_every_plan_is_whole(spark):
    fps = planted(9, 200)
    distinct = spark.createDataFrame([(x, 0) for x in fps], "fp long, low long")
    halves, quarters = [list(range(32)), list(range(32, 64))], [list(range(i, i + 16)) for i in range(0, 64, 16)]
    want = brute_components([x & (1 << 64) - 1 for x in fps], 2)
    for chosen in ([(halves[0], 1), (halves[1], 0)], [(quarters[0], 0), (quarters[1], 0), (quarters[3], 0)], [(quarters[2], 1), (quarters[1], 0)] if False else [(list(range(64)), 2)]):
        tables = Tables(spark)
        got = {r.node: r.root for r in s.components(s.links(distinct, chosen, 2, tables), tables).collect()}
        assert len({got.get(f, f) for f in fps}) == len(set(want.values()))


def test_allocation_is_optimal():
    cost = [{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 7, 1: 9}, {-1: 0, 0: 1, 1: 90}]
    import itertools

    best = min(sum(c[t] for c, t in zip(cost, ts, strict=True)) for ts in itertools.product((-1, 0, 1), repeat=3) if sum(ts) == 0)
    c, chosen = s.allocate(cost, 0)
    assert c == best and sum(chosen) == 0


def test_links_that_differ_in_the_highest_bit(spark):
    unsigned = lambda x: x & (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bases = [int(x) for x in np.random.default_rng(63).integers(0, 1 << 64, 63, np.uint64)]
    fps = sorted({signed(x) for k, b in enumerate(bases) for x in (b, b ^ 1 << 63 ^ 1 << k)} | {signed(bases[0] ^ (1 << 64) - 1)})
    distinct, tables = spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "fp long, low long"), Tables(spark)
    edges = s.links(distinct, s.plan(distinct, len(fps), 2), 2, tables).collect()
    near = lambda a, b: (unsigned(a) ^ unsigned(b)).bit_count() <= 2
    assert {(e.a, e.b) for e in edges} == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if near(a, b)}
    assert len(edges) >= 63
