"""Near-duplicate texts against brute force over all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neartexts as n

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_shingles(text, k=5):
    words = (text or "").encode().decode("utf-8", "replace").translate(LOWER).replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_roots(sets, least=0.8):
    """The smallest place reachable, for each set, and the links between different sets."""
    distinct = sorted(set(sets), key=sets.index)
    by, links = defaultdict(list), set()
    for i, s in enumerate(distinct):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(distinct):
        near = {j for x in s for j in by[x] if j > i}
        links |= {(i, j) for j in near if alike(s, distinct[j]) >= least}
    root = list(range(len(distinct)))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= (root[i], root[j]) != (low, low)
            root[i] = root[j] = low
    first = {s: i for i, s in enumerate(distinct)}
    return [root[first[s]] for s in sets], {(distinct[i], distinct[j]) for i, j in links}


def classes(ids, roots):
    out = defaultdict(list)
    for i, r in zip(ids, roots, strict=True):
        out[r].append(i)
    return {tuple(sorted(x)) for x in out.values()}


def made(seed, texts=40, copies=8, words=120):
    """Texts with copies of every similarity, and a crowd of near copies of one."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(900)]
    out = []
    for _ in range(texts):
        body = [r.choice(vocabulary) for _ in range(r.randint(5, 2 * words))]
        out.append(body)
        for _ in range(r.randint(0, copies)):
            out.append([w if r.random() > 0.03 else r.choice(vocabulary) for w in body])
    crowd = [r.choice(vocabulary) for _ in range(words)]
    out += [[w if r.random() > x else r.choice(vocabulary) for w in crowd] for x in (0.002, 0.01, 0.04) for _ in range(60)]
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("seed", (1, 2))
def test_components_of_made_texts(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(n, "BLOCK", 16)  # signatures of more texts are dealt out to pairs of blocks
    texts = made(seed)
    rows = n.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    roots, links = brute_roots([brute_shingles(t) for t in texts])
    got = {r.doc_id: r.component_id for r in rows}
    at = {brute_shingles(t): i for i, t in enumerate(texts)}
    met = sum(got[at[a]] == got[at[b]] for a, b in links)
    assert len(links) > 300 and met / len(links) > 0.98
    want = classes(range(len(texts)), roots)
    whole = {i: c for c in want for i in c}
    assert all(len({whole[i] for i in c}) == 1 for c in classes(got, got.values()))  # nothing is wrongly merged
    assert all(c == min(i for i, x in got.items() if x == c) for c in got.values())


def test_recall_at_the_least_similarity(spark):
    """Pairs of a similarity of just 0.8: of 100 shingles a side, 80 of 100 shared in a union of 100."""
    r = random.Random(9)
    texts = []
    for _ in range(300):
        body = [f"{r.getrandbits(40):x}" for _ in range(94)]
        texts += [" ".join(body), " ".join(body[:-19] if len(body) > 19 else body)]
    sets = [brute_shingles(t) for t in texts]
    near = [alike(sets[i], sets[i + 1]) for i in range(0, len(sets), 2)]
    assert all(0.78 < x < 0.82 for x in near)
    got = {x.doc_id: x.component_id for x in n.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=0.78).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, len(texts), 2)) / 300 > 0.95
    assert all(got[i] // 2 == i // 2 for i in got)


def test_plan_reaches_its_recall():
    products = np.full((n.WORDS, n.BITS, n.BITS), 2500)
    for w in range(n.WORDS):
        np.fill_diagonal(products[w], 5000)
    for total in (200, 10_000, 10_000_000):
        chosen = n.plan(products * total // 10_000, total, 0.8, 0.98)
        missed = np.prod([1 - n.within(len(bits), n.flip_rate(0.8), t) for _, bits, t in chosen])
        assert missed <= 0.02 + 1e-9
        assert len({(w, b) for w, bits, _ in chosen for b in bits}) == sum(len(bits) for _, bits, _ in chosen)


def test_allocation_is_optimal():
    import itertools

    r = random.Random(4)
    for _ in range(20):
        options = [{t: (r.randint(1, 50), r.randint(1, 9) / 10) for t in range(3)} for _ in range(4)]
        found = n.allocate(options, 1.0, steps=10)
        totals = [(sum(o[t][0] for o, t in zip(options, ts, strict=True) if t >= 0), sum(int(o[t][1] * 10) for o, t in zip(options, ts, strict=True) if t >= 0)) for ts in itertools.product((-1, 0, 1, 2), repeat=4)]
        best = min(c for c, gain in totals if gain >= 10)
        assert found[0] == best == sum(o[t][0] for o, t in zip(options, found[1], strict=True) if t >= 0)
    assert n.allocate([{0: (1.0, 0.1)}], 1.0) is None


def test_nearest_of_a_crowd():
    g, i, j = np.array([1, 1, 1, 2, 2]), np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4])
    many, groups = n._crowded(g, i)
    assert not many.any() and not len(groups)
    i, j = np.triu_indices(20, 1)
    many, groups = n._crowded(np.zeros(20, np.int64), i)
    assert many.all() and list(groups) == [0]
    d = (i * 7 + j * 3) % 11
    for most in (1, 3):
        keep = n._nearest(i, j, d, most)
        for x in range(20):
            own = np.flatnonzero((i == x) | (j == x))
            assert keep[own[np.argsort(d[own], kind="stable")[:most]]].all()
        assert keep.sum() <= 20 * most


def test_few_candidates_are_all_taken(spark):
    star = [(0, x, x % 5 + 1) for x in range(1, 30)] + [(1, 2, 0), (3, 4, 9)]
    got = {(r.a, r.b) for r in n._next(spark.createDataFrame(star, "a long, b long, d long")).collect()}
    assert got == {(a, b) for a, b, _ in star}  # each ray is its far end's only candidate
    full = [(a, b, (a * 5 + b) % 13) for a in range(12) for b in range(a + 1, 12)]
    got = {(r.a, r.b) for r in n._next(spark.createDataFrame(full, "a long, b long, d long")).collect()}
    assert 6 <= len(got) <= 12 and {x for p in got for x in p} == set(range(12))


def test_edge_rows(edge, empty):
    rows = n.near_texts(edge).collect()
    assert len(rows) == edge.count() and n.near_texts(empty).count() == 0
    texts = [(r.doc_id, r.text) for r in edge.collect()]
    roots, _ = brute_roots([brute_shingles(t) for _, t in texts])
    low = {}
    for (i, _), root in zip(texts, roots, strict=True):
        low[root] = min((x for x in (i, low.get(root)) if x is not None), default=None)
    want = sorted(((i, low[root]) for (i, _), root in zip(texts, roots, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=repr) == want


def test_keep_one(edge, empty):
    kept = n.keep_one(edge)
    assert kept.columns == edge.columns and n.keep_one(empty).count() == 0
    found = n.near_texts(edge)
    assert kept.count() == found.select("root").distinct().count()
    assert {r.component_id for r in found.where(F.col("component_id").isNotNull()).collect()} <= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("first", (1, 4))
def test_no_link_is_missed(spark, first, monkeypatch):
    """Exactly the components of brute force, in crowds too, though fingerprints are asked for few links and texts for one partner at a time."""
    monkeypatch.setattr(n, "FIRST", first)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    crowd = [" ".join(w if r.random() > 0.025 else f"x{r.randrange(10**6)}" for w in base) for _ in range(150)]  # many pairs on either side of 0.8
    line = " ".join(base[:30])
    lined = [line + " " + " ".join(f"y{r.randrange(10**6)}" for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts = made(3) + crowd + lined + ["", "one", "one two three", None]
    rows = n.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    roots, links = brute_roots([brute_shingles(t) for t in texts])
    assert len(links) > 1000
    got = {x.doc_id: x.component_id for x in rows}
    assert classes(got, got.values()) == classes(range(len(texts)), roots)


def test_partners_of_a_token():
    r = np.random.default_rng(2)
    token = np.sort(r.integers(0, 12, 200))
    root, size, place = r.integers(0, 6, 200), r.integers(8, 14, 200), r.integers(0, 3, 200)

    def may(i, j):
        both = min(size[i] - place[i], size[j] - place[j])
        return token[i] == token[j] and root[i] != root[j] and both >= 0.8 / 1.8 * (size[i] + size[j]) - 1e-6

    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if may(i, j)}
    i, j, left = n._partners(token, root, size, place, 0.8, 1000, step=50)
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want) and not len(left)
    i, j, left = n._partners(token, root, size, place, 0.8, 2)
    some = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert some < want and {token[a] for a, _ in want - some} == set(left.tolist())


def test_most_shared_is_a_bound():
    r = np.random.default_rng(8)
    for _ in range(300):
        both = r.permutation(400)
        a, b = (np.unique(np.concatenate((both[:k], r.choice(both, k)))).astype(np.uint64) for k in r.integers(1, 120, 2))
        known = np.sort(r.choice(400, 60, replace=False)).astype(np.uint64)
        times = r.integers(4, 9, 60)
        rank = lambda v: np.array([dict(zip(known.tolist(), times.tolist(), strict=True)).get(int(x), 0) for x in v])
        x, y = (n.prefix_of(s, 0.8, known, times) for s in (a, b))
        assert n.most_shared(x, y, rank(x), rank(y), (len(a), len(b))) >= len(np.intersect1d(a, b))


def test_counts_are_a_bound():
    r = np.random.default_rng(6)
    new = lambda k: np.unique(r.integers(0, 2**63, k).astype(np.uint64))
    pairs = []
    for k in (*r.integers(1, 900, 120), 90_000):  # the last has bins that are full
        both = new(k)
        pairs += [tuple(np.union1d(both[: int(k * share)], new(int(k * (1 - share)) + 1)) for share in (x, x)) for x in (0.0, 0.7, 0.88, 0.95)]
    counts = [np.stack([n.counts_of(p[i]) for p in pairs]) for i in (0, 1)]
    may = n.may_be_alike(*counts, tuple(np.array([len(p[i]) for p in pairs]) for i in (0, 1)), 0.8)
    near = np.array([n.jaccard(*p) >= 0.8 for p in pairs])
    assert near.sum() > 100 and may[near].all() and (counts[0] == n.FULL).any()
    apart = np.array([n.jaccard(*p) == 0 and 20 < len(p[0]) < 900 for p in pairs])
    assert apart.sum() > 100 and not may[apart].any()


def test_texts_are_found_again_without_python(spark, monkeypatch):
    """Texts of a third of common words meet under these but aren't near; a text is not hashed in Python to be found again."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(10**6)}"
    common = [word() for _ in range(60)]
    texts = made(4, texts=10) + [" ".join([*common, *(word() for _ in range(110))]) for _ in range(60)] + ["", None]
    texts += texts[:5] + [texts[0].upper()]
    plans, whole = [], n._sets

    def sets(nodes, docs, shingle):
        out = whole(nodes, docs, shingle)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert sorted(x.node for x in out.collect()) == sorted(x.node for x in nodes.collect())
        return out

    monkeypatch.setattr(n, "_sets", sets)
    monkeypatch.setattr(n, "SAMPLE", 1)  # no order of shingles helps
    rows = n.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    roots, _ = brute_roots([brute_shingles(t) for t in texts])
    got = {x.doc_id: x.component_id for x in rows}
    assert classes(got, got.values()) == classes(range(len(texts)), roots)
    assert plans and all(p.count("ArrowEvalPython") == 1 for p in plans)


@pytest.mark.parametrize("long", (0, 50))
def test_long_texts_are_judged_by_prefixes_too(spark, long, monkeypatch):
    monkeypatch.setattr(n, "LONG", long)
    texts = made(5, texts=25) + ["", None]
    rows = n.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    roots, _ = brute_roots([brute_shingles(t) for t in texts])
    got = {x.doc_id: x.component_id for x in rows}
    assert classes(got, got.values()) == classes(range(len(texts)), roots)


def test_later_rounds_list_only_what_is_asked_again(spark, monkeypatch):
    """After the first round neither all texts nor all of their shingles are listed, or joined with their components, again."""
    monkeypatch.setattr(n, "FIRST", 1)
    r = random.Random(11)
    line = [f"z{i}" for i in range(30)]
    texts = made(6, texts=15) + [" ".join(line + [f"y{r.randrange(10**6)}" for _ in range(r.randint(1, 12))]) for _ in range(60)]
    plans, rows, met = [], [], n._met

    def recorded(listed, similarity, most):
        plans.append(listed._jdf.queryExecution().optimizedPlan().toString())
        rows.append(listed.count())
        return met(listed, similarity, most)

    monkeypatch.setattr(n, "_met", recorded)
    found = n.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    roots, _ = brute_roots([brute_shingles(t) for t in texts])
    got = {x.doc_id: x.component_id for x in found}
    assert classes(got, got.values()) == classes(range(len(texts)), roots)
    assert len(plans) > 2 and "Generate" in plans[0] and not any("Generate" in p for p in plans[1:])
    assert rows == sorted(rows, reverse=True) and 2 * rows[1] < rows[0]


def test_partners_of_a_crowd_take_little_memory():
    import tracemalloc

    size = 3000
    one = np.zeros(size, np.int64)
    tracemalloc.start()
    i, _, left = n._partners(one, np.arange(size), one + 50, one, 0.8, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 4 * (size - 4) + 6 and list(left) == [0]
    assert peak < 48e6


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    from tessera.llm import _shared

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own, seen, placed = spark.conf.get(name), [], n._placed
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    monkeypatch.setattr(n, "_placed", lambda *x: seen.append(spark.conf.get(name)) or placed(*x))
    assert n.near_texts(docs).count() == 2
    assert seen == [str(n.BATCH_BYTES)] and spark.conf.get(name) == own
    monkeypatch.setattr(n, "_placed", lambda *x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        n.near_texts(docs)
    assert spark.conf.get(name) == own

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    wide = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    with _shared.arrow_bytes(spark, 1 << 16):
        assert wide.mapInArrow(rows, "n long").agg(F.max("n")).first()[0] <= 100
    texts = pa.chunked_array([["a", None, "é"], ["b"] * 500])
    assert iter(x := _shared.utf8(texts)) is x and list(x) == [b"a", None, "é".encode(), *[b"b"] * 500]
