import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid as g


def test_held_out_accuracy(docs):
    model = g.fit(docs.where(~g.held_out(F.col("doc_id"))))
    rows = g.identify(docs.where(g.held_out(F.col("doc_id"))), model).where("lang is not null").select("lang", "language.*").toDF("want", "got", "score", "languages", "shares").collect()
    assert len(rows) > 30 and sum(r.want == r.got for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and abs(sum(r.shares) - 1) < 1e-6 for r in rows)


def test_counts_are_whole(docs):
    rows = docs.where("lang = 'en'").limit(30).persist()
    counts = np.full(g.BUCKETS, 0.05)
    for r in rows.collect():
        counts += np.bincount(g.grams(r.text.encode()), minlength=g.BUCKETS)
    assert np.allclose(g.fit(rows).likelihood[:, 0], counts / counts.sum())


def test_em_recovers_a_mixture():
    rng = np.random.default_rng(5)
    like = rng.dirichlet(np.full(60, 0.3), 3).T
    true = np.array([0.7, 0.3, 0.0])
    n = rng.multinomial(20_000, like @ true).astype(float)
    got = g.proportions(like + 1e-12, n, np.full(3, 1 / 3), rounds=200, tolerance=1e-7)
    assert np.abs(got - true).max() < 0.03


def test_mixed_text_names_both_languages(docs):
    model = g.fit(docs)
    by = {r.lang: r.text for r in docs.where("length(text) between 1500 and 4000").collect()}
    names = sorted(by)[:2]
    half = lambda t: t[: 1400]
    found = g.infer(model, (half(by[names[0]]) + " " + half(by[names[1]])).encode())
    assert set(names) <= set(found[2])


def test_edge_rows(edge, empty, docs):
    model = g.fit(docs)
    rows = g.identify(edge, model, to="found").select("text", "found.*").collect()
    assert len(rows) == edge.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang in model.languages and 0 < r.score <= 1 if letters else (r.lang, r.score) == ("und", 0.0)
    assert g.identify(empty, model).count() == 0
    assert g.infer(g.fit(empty), b"text")[0] == "und"


def test_keeping(edge, empty):
    kept = g.keep_identified(edge)
    assert kept.columns == edge.columns and 0 < kept.count() < edge.count() and g.keep_identified(empty).count() == 0
    assert kept.where("text is null or text in ('', '...')").count() == 0


def five(rounds=40):
    """A model of five languages of distinct words, and words of each."""
    words = {lang: [f"{a}{lang}{b}{lang}{a}" for a in "aeiou" for b in "bdfg"] for lang in "klmnp"}
    counts = np.full((g.BUCKETS, 5), 0.05)
    for i, ws in enumerate(words.values()):
        counts[:, i] += np.bincount(g.grams(" ".join(ws * rounds).encode()), minlength=g.BUCKETS)
    return g.Model(tuple(words), counts / counts.sum(axis=0)), {k: " ".join(ws * 5) for k, ws in words.items()}


def test_all_languages_of_a_text_are_named():
    model, by = five()
    _, score, names, shares = g.infer(model, " ".join(by.values()).encode())
    assert set(names) == set("klmnp") and np.abs(np.array(shares) - 0.2).max() < 0.05
    assert score < 1 / 3  # so keep_identified rejects it
    assert g.infer(model, by["k"].encode())[2] == ["k"]


def test_the_whole_text_decides():
    model, by = five()
    text = by["k"] + " " + by["m"] + " " + " ".join(by["m"].split()[:4])
    for data in (text, " ".join(reversed(text.split()))):
        lang, score, names, shares = g.infer(model, data.encode())
        assert set(names) == {"k", "m"} and min(shares) >= 0.9 * max(shares)
        assert lang == "m" and score == max(shares)


def test_any_letter_gets_a_language(docs):
    model = g.fit(docs)
    for text in ("a", "I", "a.", " . x . ", "é", "日", "7 я", "\u00a0ß"):
        lang, score, names, shares = g.infer(model, text.encode())
        assert lang in model.languages and 0 < score <= 1 and names and abs(sum(shares) - 1) < 1e-9
    for text in ("", "7", "², ½", "_", "\u00a0", "—"):
        assert g.infer(model, text.encode()) == ("und", 0.0, [], [])


def test_column_of_the_same_name_is_replaced(edge, docs):
    found = g.identify(edge, g.fit(docs))
    assert sorted(found.columns) == sorted(edge.columns) and found.schema["language"].dataType.typeName() == "struct"
