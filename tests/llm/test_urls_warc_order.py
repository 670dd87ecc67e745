import hashlib

import pytest

from tessera.llm import ordermin as o
from tessera.llm import queries as q
from tessera.llm import revisit as w
from tessera.llm import urlrules as u
from tessera.llm._shared import Tables
from tests.compare import duck, same


def judge(host, path, rules):
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/1", "https://a.example.com/de/x?y=1#z", "http://xexample.com/de/", "http://shop.fr.org/fr/1", "http://b.net", "ftp://net/", "https://x.org/fr", "x://y://z/w", "http://ÄB.Net/é?q", "https://h.example.net/en\n/2", "a://" + "l." * 900 + "com/" + "d/" * 900 + "?" + "&".join(f"k{i}=1" for i in range(400))]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, x, "host") for i, x in enumerate(URLS)] + [(3, "http://again.org/fr/", "x"), (None, "http://b.net/", None)], "page_id long, url string, host string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")


def test_url_parts_and_list(pages, labels):
    for r in u.judge(pages, labels, q.URL_RULES).join(pages.select("page_id", "url").distinct(), "page_id").collect():
        rest = (r.url or "").split("://", 1)
        rest = rest[1] if len(rest) > 1 else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        if r.page_id != 3:
            assert (r.host, r.path) == (host, path)
            want = judge(host, path, q.URL_RULES)
            assert (r.rule, r.verdict) == ((want[0], want[1]) if want else (None, r.verdict)) and r.verdict in ("allow", "block")


def test_nothing_to_judge(pages, labels):
    assert u.judge(pages.limit(0), labels, q.URL_RULES).count() == 0
    assert u.judge(pages, labels.limit(0), []).where("verdict = 'block'").count() == 0


def test_mined_rules_against_brute_force(spark):
    import itertools

    rows = [(sorted(x), y) for x, y in ([(["a", "b", "c"], "block")] * 30 + [(["a", "b"], "block")] * 10 + [(["a"], "allow")] * 40 + [(["c", "d"], "allow")] * 25 + [(["d"], "block")] * 3)]
    df = spark.createDataFrame(rows, "items array<string>, label string")
    got = {(tuple(r["items"]), r.label): (r.n, round(r.confidence, 9)) for r in u.mine(df, Tables(spark), 0.05, 5, 0.9).collect()}
    sets, hits = {}, {}
    for items, y in rows:
        for k in range(1, len(items) + 1):
            for c in itertools.combinations(items, k):
                sets[c] = sets.get(c, 0) + 1
                hits[c, y] = hits.get((c, y), 0) + 1
    strong = {k: (n, round(n / sets[k[0]], 9)) for k, n in hits.items() if n >= 0.05 * len(rows) and n >= 5 and n / sets[k[0]] >= 0.9}
    implied = {k for k in strong for x in k[0] if (tuple(i for i in k[0] if i != x), k[1]) in strong and strong[tuple(i for i in k[0] if i != x), k[1]][1] >= strong[k][1]}
    assert got == {k: v for k, v in strong.items() if k not in implied}
    urls = spark.createDataFrame([(["a", "b", "z"],), (["a"],), (["c", "d"],)], "items array<string>")
    best = {tuple(r["items"]): r.best.label for r in u.match(urls, u.mine(df, Tables(spark), 0.05, 5, 0.9), Tables(spark)).collect()}
    assert best == {("a", "b", "z"): "block", ("c", "d"): "allow"}


def test_revisits_equal_sql(spark, sf_dir):
    same(q.op7_warc_revisit(spark, sf_dir), duck(sf_dir), q.ORACLES["op7_warc_revisit"])


def captures(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, digest string, headers map<string,string>, body string, block int")


def test_revisit_cases(spark):
    url, full = "http://www.A.com:80/x/?b=2&a=1&utm_x=1#f", {"ETag": '"1"', "Content-Type": "text/html", "X": "keep"}
    rows = [
        (1, url, 10, "response", 200, "d1", full, "body1", 1), (2, "https://a.com/x?a=1&b=2", 20, "revisit", 304, None, {"etag": 'W/"1"', "Date": "20", "X": "drop"}, None, 1),
        (3, url, 20, "response", 200, "d3", {"ETag": '"3"'}, "body3", 1), (4, url, 30, "revisit", 304, None, {"ETag": '"1"'}, None, 1), (5, url, 30, "response", 404, "d5", {"ETag": '"5"'}, None, 1),
        (6, url, 40, "revisit", 304, "d3", None, None, 1), (7, None, 40, "revisit", 304, None, None, None, 1), (8, "http://b.com/", 5, "revisit", 304, None, {}, None, 1), (9, url, None, "revisit", 304, None, None, None, 1), (10, url, 50, None, None, None, None, None, None),
        (11, url, 50, "revisit", 304, None, {"Date": None, "Vary": "v"}, None, 1),
    ]
    for size in (4096, 2):
        got = {r.record_id: r for r in w.resolve(captures(spark, rows), rows_per_block=size, payload="body").collect()}
        assert {i: r.outcome for i, r in got.items()} == {1: "full", 2: "resolved", 3: "full", 4: "mismatch", 5: "full", 6: "resolved", 7: "missing", 8: "missing", 9: "missing", 10: "full", 11: "unvalidated"}
        assert (got[2].source_id, got[2].status, got[2].digest, got[2].body) == (1, 200, "d1", "body1") and got[2].headers == {"etag": 'W/"1"', "content-type": "text/html", "x": "keep", "date": "20"}
        assert (got[6].source_id, got[6].body) == (3, "body3") and got[4].source_id is None and got[11].headers == {"etag": '"3"', "vary": "v"}
    assert w.resolve(captures(spark, rows).limit(0)).count() == 0


def test_hot_url_against_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(i, "http://hot.com/" if i % 3 else f"http://c{i % 7}.com/", r.randint(0, 400), "response" if r.random() < 0.3 else "revisit", 200, None, {}, None, 1) for i in range(1500)]
    got = {x.record_id: x.source_id for x in w.resolve(captures(spark, rows), rows_per_block=64).where("kind = 'revisit'").collect()}
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            before = [(t, j) for j, v, t, k, *_ in rows if v == url and k == "response" and t < ts]
            assert got[i] == (max(before)[1] if before else None)


def omh(text, k=o.K, ell=o.TUPLE, rows=o.ROWS):
    """The definition, one k-mer and one hash function at a time."""
    import numpy as np

    if not text:
        return [0] * rows
    with np.errstate(over="ignore"):
        mers = o.numbered_kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
        a, b = o._multipliers(rows, 7)
        out = []
        for i in range(rows):
            h = [(int(x) >> 32) * int(a[i, 0]) % 2**32 for x in mers]
            h = [((x ^ (x >> 15)) + int(b[i, 0])) % 2**32 for x in h]
            picked = sorted(sorted(range(len(h)), key=lambda j: (h[j], j))[:ell])
            out.append((len(picked), tuple(int(mers[j]) for j in picked)))
    return out


def test_fingerprints_follow_the_definition():
    texts = ["", "a", "abc", "abcdef", "abcdefg", "aaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog", "日本語のテキスト" * 5]
    for x in texts:
        for y in texts:
            assert ((o.fingerprint(x) == o.fingerprint(y)).tolist()) == [p == r for p, r in zip(omh(x), omh(y), strict=True)]


def test_numbering_counts_occurrences():
    import numpy as np

    codes = np.frombuffer("abababab".encode("utf-32-le"), np.uint32)
    assert len(set(o.numbered_kmers(codes, 2).tolist())) == 7


def test_likeness_falls_when_text_moves():
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3
    moved = a[120:] + a[:120]
    assert o.likeness(o.fingerprint(a), o.fingerprint(a)) == 1 and o.likeness(o.fingerprint(a), o.fingerprint(moved)) < 0.95
    assert o.likeness(o.fingerprint(a), o.fingerprint(a.replace("seven", "siebn", 1))) > o.likeness(o.fingerprint(a), o.fingerprint("nothing alike here " * 9))


def test_blocks_do_not_change_fingerprints(monkeypatch):
    text = "".join(chr(97 + (i * i) % 23) for i in range(5000))
    whole = o.fingerprint(text)
    pair = o.fingerprint_pair(text, text[:3750] + "z" * 1250, 3750)
    monkeypatch.setattr(o, "BLOCK", 700)
    assert (o.fingerprint(text) == whole).all() and (pair[0] == whole).all() and (pair[1] == o.fingerprint(text[:3750] + "z" * 1250)).all()


@pytest.mark.parametrize("size", [2048, 7])
def test_documents_in_order(edge, empty, docs, size):
    for df in (edge.withColumnRenamed("words", "block"), docs.limit(120)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        want = []
        for i, (id_, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            e = o.edited(text, after)
            mark = o.fingerprint(text)
            want.append((id_, len(text), hashlib.sha256(e.encode()).hexdigest(), mark.astype(">u4").tobytes().hex(), o.fingerprint(e).astype(">u4").tobytes().hex(), o.likeness(mark, o.fingerprint(e)), o.likeness(mark, o.fingerprint(after))))
        got = [tuple(r) for r in o.compare_in_order(df, rows_per_block=size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert o.compare_in_order(empty).count() == 0
    one = docs.limit(1)
    assert o.compare_in_order(one).first().near_next == 1.0
