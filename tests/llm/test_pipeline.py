"""The pipeline stage by stage against brute force, and the registered queries."""

from collections import Counter

import pytest

import corpus_pipeline as p
from tessera.llm import mixing, queries
from tests.compare import duck, same
from tests.llm.test_decontam import brute
from tests.llm.test_neartexts import brute_roots, brute_shingles


def test_stages(spark, sf_dir, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    now, seen = docs, docs.collect()
    for name, stage in p.STAGES:
        out = stage(spark, now, sf_dir).persist()
        rows = out.collect()
        if name != "shard":
            assert out.columns == docs.columns
        if name == "language":
            assert 0.98 * len(seen) <= len(rows) <= len(seen)
        if name == "near_duplicates":
            roots, _ = brute_roots([brute_shingles(r.text) for r in seen])
            low = {}
            for r, root in zip(seen, roots, strict=True):
                low[root] = min(r.doc_id, low.get(root, r.doc_id))
            assert sorted(r.doc_id for r in rows) == sorted(low.values())
        if name == "decontaminate":
            bad = {i for i, _, _, _, c in brute([(r.doc_id, r.text) for r in seen], bench, 13) if c}
            assert {r.doc_id for r in rows} == {r.doc_id for r in seen} - bad
        if name == "mix":
            want = {r.doc_id: r.copies for r in mixing.mix(now).collect() if r.copies}
            assert Counter(r.doc_id for r in rows) == want
        if name == "shard":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in seen) and {r.shard for r in rows} == set(range(40))
        now, seen = out, rows
    assert sorted(map(repr, p.run(spark, sf_dir).collect())) == sorted(map(repr, seen))


def test_stages_on_edge_rows(spark, sf_dir, edge, empty):
    for first in (edge, empty):
        now = first
        for name, stage in p.STAGES:
            now = stage(spark, now, sf_dir).persist()
            assert name == "shard" or now.columns == first.columns
            now.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_every_row(spark, sf_dir, name):
    table = "pages" if name.startswith(("op5_", "op7_")) else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert queries.QUERIES[name](spark, sf_dir).count() == n * (2 if name.startswith("op7_") else 1)


def test_registered():
    import __spark_entry__ as e

    assert {"pipeline", *queries.QUERIES} <= set(e.queries())
