import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import mixing as m
from tessera.llm import sharding as s


def wanted(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda x: (x is None, x))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, total = {n: 0.0 for n in names}, float(sum(sizes.values()))
    open_ = set(names)
    while open_:
        left = total - sum(cap * sizes[n] for n in names if n not in open_)
        share = {n: left * w[n] / sum(w[k] for k in open_) for n in open_}
        over = {n for n in open_ if share[n] > cap * sizes[n]}
        if not over:
            out.update(share)
            break
        for n in over:
            out[n] = float(cap * sizes[n])
        open_ -= over
    return out


def check(df, tolerance):
    rows = m.mix(df, rows_per_bucket=16).collect()
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, taken, largest = wanted(sizes), Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for n, t in want.items():
        assert abs(taken[n] - t) <= max(tolerance * t, largest[n])
    return rows


def test_edge_rows(edge, empty):
    rows = check(edge, 0.01)
    assert len(rows) == edge.count() and m.mix(empty).count() == 0
    assert sorted(map(repr, rows)) == sorted(map(repr, m.mix(edge.repartition(5), rows_per_bucket=16).collect()))


def test_documents(docs):
    check(docs, 0.03)


def test_rates_solve_the_constraint(docs):
    sums = defaultdict(float)
    target = {}
    for r in m.mix(docs).collect():
        sums[r.source] += r.rate * r["size"]
        target[r.source] = r.target
        assert 0 <= r.rate <= 3
    assert all(abs(sums[n] - t) <= 1e-6 * t for n, t in target.items())


def test_words_only_in_one_source(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y"), (3, "", "y")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.target, r.copies) for r in m.mix(df).collect()}
    assert got == {1: (3.0, 1), 2: (0.0, 1), 3: (0.0, 1)}
    none = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [r.target for r in m.mix(none).collect()] == [0.0]


def test_repeat_keeps_columns(edge, empty):
    out = m.repeat(edge)
    assert out.columns == edge.columns and out.count() == sum(r.copies for r in m.mix(edge).collect())
    assert m.repeat(empty).count() == 0


def test_no_python_in_the_plan(edge):
    plan = m.mix(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("shards", [1, 7, 40, 500])
def test_shards(edge, shards):
    rows = s.interleave(edge, shards=shards, rows_per_bucket=8).collect()
    texts = [r.text or "" for r in edge.collect()]
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32(t.encode()) for t in texts)
    assert sum(r["size"] for r in rows) == sum(len(t.encode()) + 16 for t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    n = [len(by[i]) for i in range(shards)]
    assert sum(n) == len(rows) and max(n) - min(n) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def test_shards_have_the_mixture(docs):
    rows = s.interleave(docs, shards=5, rows_per_bucket=16).collect()
    whole, by = Counter(r.source for r in rows), defaultdict(Counter)
    for r in rows:
        by[r.shard][r.source] += 1
    assert all(abs(by[i][n] - whole[n] / 5) <= 1.5 for i in range(5) for n in whole)
    again = s.interleave(docs.repartition(7), shards=5, rows_per_bucket=16).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_no_rows(empty):
    assert s.interleave(empty).count() == 0


@pytest.fixture(scope="module")
def repeated(spark):
    """One row 5000 times, a text of 500 ids and a few others."""
    rows = [(1, "a b c", "x", None)] * 5000 + [(i, "d e", "y", i) for i in range(500)] + [(7, "f", None, 1), (7, "f", None, 2), (7, "f", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(6)


def test_repeated_rows_meet_in_no_bucket(repeated):
    rows = check(repeated, 0.01)
    assert len(rows) == repeated.count()
    placed = s.interleave(repeated, shards=7, rows_per_bucket=16).collect()
    n = Counter(r.shard for r in placed)
    assert len(placed) == len(rows) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in placed if r.shard == k) == list(range(v)) for k, v in n.items())
    of = Counter((r.shard, r.source) for r in placed)
    assert all(abs(of[k, "x"] - 5000 / 7) <= 1.5 for k in n)


def test_repeat_agrees_over_reruns(repeated):
    rows = lambda df: Counter(map(tuple, m.repeat(df, rows_per_bucket=16).collect()))
    first = rows(repeated)
    assert first == rows(repeated.repartition(3)) and {x[3] for x in first if x[0] == 7 and x[2] is None} <= {1, 2}
    assert sum(first.values()) == sum(r.copies for r in m.mix(repeated, rows_per_bucket=16).collect())


def test_running_sums(spark):
    from tessera.llm import _shared

    counts = [(k, at * 3, (at * 7 + k) % 11) for k in (1, 2) for at in range(9000)]
    got = {(r.k, r["at"]): r.before for r in _shared.running(spark.createDataFrame(counts, "k int, at long, n long"), ["k"], "at", "n", "before").collect()}
    total = Counter()
    for k, at, n in counts:
        assert got[k, at] == total[k]
        total[k] += n
