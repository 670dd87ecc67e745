import re

import pytest

from tessera.llm import decontam as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, width):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[s : s + width]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def bench(spark, edge):
    long_ = [r.text for r in edge.collect() if r.text and 40 < len(r.text.split()) < 200]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(1, part(long_[0], 3, 40)), (2, part(long_[1], 0, 13).upper()), (3, "one"), (4, None), (5, "..."), (6, "a a a a a a a a a a a a a a a"), (7, "two; words"), (None, part(long_[2], 5, 30)), (1, "not in any document at all but long enough to be two windows here")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [50_000, 2])
@pytest.mark.parametrize("width", [13, 5])
def test_against_brute_force(edge, bench, limit, width):
    want = brute([(r.doc_id, r.text) for r in edge.collect()], [tuple(r) for r in bench.collect()], width)
    assert found(d.contamination(edge, bench, width=width, literal_limit=limit)) == want


def test_documents(docs, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 13)
    assert found(d.contamination(docs, bench)) == want


def test_empty_tables(edge, empty, bench):
    assert d.contamination(empty, bench).count() == 0
    assert not d.contamination(edge, bench.limit(0)).where("contaminated or n_hit > 0").count()


def test_dropping(edge, bench):
    bad = d.contamination(edge, bench).where("contaminated").count()
    kept = d.drop_contaminated(edge, bench)
    assert bad > 0 and kept.columns == edge.columns and kept.count() == edge.count() - bad


def test_no_python_in_the_plan(edge, bench):
    plan = d.contamination(edge, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
