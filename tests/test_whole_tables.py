"""Queries that must read their whole tables."""

import hashlib

import pytest

from tessera.plans.all import QUERIES
from tessera.plans.scalars import detections


def test_fast_hash_of_long_texts(spark, tmp_path):
    edge = 1 << 20
    texts = ["", "short", "é" * (edge // 2), "a" * edge + "b", "".join(map(str, range(edge // 2)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def fast(i, data):
        return hashlib.sha256(str(len(data)).encode() + str(i * 1000).encode() + data[:edge] + (data[-edge:] if len(data) > edge else b"")).hexdigest()

    got = {r.doc_id: r.fast for r in QUERIES["b14_fast_hash"](spark, str(tmp_path)).collect()}
    assert got == {i: fast(i, t.encode()) for i, t in enumerate(texts)}


def test_diverse_references_of_every_job(spark, sf_dir):
    frames = detections(spark, sf_dir).select("job_id", "frame_index").distinct().collect()
    of = {(r.job_id, r.frame_index) for r in frames}
    want = {(j, t) for j, t in of if any((j, t + k) in of for k in range(-20, 21) if k)}
    rows = QUERIES["f05_diverse_references"](spark, sf_dir).collect()
    assert {(r.job_id, r.target) for r in rows} == want and len({j for j, _ in want}) > 1
    assert all((r.job_id, r.ref) in of and 1 <= abs(r.target - r.ref) <= 20 for r in rows)


@pytest.mark.parametrize("name", ("d12_flicker", "i10_alignment"))
def test_clips_of_one_file_are_the_work_of_many_tasks(spark, tmp_path, name):
    spark.range(200).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 3
