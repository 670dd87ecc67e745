import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import config
from tessera.operators import decide, jobs, match
from tessera.sources import audit, checkpoints, files
from tests.compare import same


def test_config_layers():
    tree = config.load([{"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}], ["a.d=[1, 2]", "e=text"])
    assert tree == {"a": {"b": 3, "c": 2, "d": [1, 2]}, "e": "text"} and config.get(tree, "a.c") == 2 and config.get(tree, "x.y", 7) == 7
    assert config.stable_hash({"a": 1, "b": 2}) == config.stable_hash({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        config.load([{"version": 99}])


def test_jobs_are_idempotent(spark):
    schema = "input_hash string, config_hash string, model_hash string, output string, priority int, request_id long"
    asked = spark.createDataFrame([("i", "c", "m", "o1", 0, 1), ("i", "c", "m", "o2", 5, 2)], schema)
    empty = spark.createDataFrame([], "input_hash string, config_hash string, model_hash string, job_id string, output string, priority int, state string")
    once = jobs.get_or_create(empty, asked)
    twice = jobs.get_or_create(once, asked)
    assert once.collect() == twice.collect() and once.count() == 1 and once.first().output == "o2"


def test_checkpoints_resume(spark, tmp_path):
    path = str(tmp_path / "ck")
    rows = [("j", s, f, f * 40, bytearray(b"x")) for s in ("a", "b") for f in range(3)]
    frames = spark.createDataFrame(rows, "job_id string, segment_id string, frame_index long, pts_us long, pixels binary")
    checkpoints.write(frames, path)
    checkpoints.write(frames.where("segment_id = 'b'").limit(2), path)
    manifest = spark.createDataFrame([("j", "a", 3), ("j", "b", 3), ("j", "c", 3)], "job_id string, segment_id string, frames long")
    todo = checkpoints.pending(manifest, checkpoints.read(spark, path), manifest)
    assert sorted(r.segment_id for r in todo.collect()) == ["b", "c"]


def test_files_and_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.MP4", "a.mkv", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"data")
    found = files.with_hash(files.scan(spark, str(tmp_path / "in"), content=True))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.mkv", "b.MP4"]
    assert found.first().hash == "3a6eb0790f39ac87c94f3856b2dd2c5d110e6811602261a9a923d3bb23adc8b7"
    audit.write_json(found.select("path"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert "| segments | 3 |" in audit.markdown({"job_id": "j", "segments": 3})


def test_strict_zip_fails_on_a_missing_partner(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(2).withColumn("y", F.lit(2))
    with pytest.raises(Exception, match="sides differ"):
        match.zip_strict(a, b, ["id"]).collect()


def test_router_examples(spark):
    base = {"segment_id": 1, "job_id": 1, "frame_count": 40, "mask_ratio_of_frame": 0.02, "mean_clean_plate_coverage": 0.95, "mean_clean_plate_confidence": 0.9, "mean_flow_confidence": 0.9, "foreground_crossing_score": 0.1, "flicker_risk": 0.1, "largest_residual_component_px": 4, "residual_mask_ratio_of_roi": 0.001}
    cases = [({}, "tbe_only"), ({"mask_ratio_of_frame": 0.0}, "copy"), ({"frame_count": 4}, "review"), ({"mean_clean_plate_coverage": 0.7, "residual_mask_ratio_of_roi": 0.05, "largest_residual_component_px": 5000}, "tbe_lama"), ({"mean_clean_plate_coverage": 0.7, "residual_mask_ratio_of_roi": 0.05}, "tbe_telea"), ({"mean_clean_plate_coverage": 0.3, "residual_mask_ratio_of_roi": 0.5}, "official_propainter")]
    df = spark.createDataFrame([base | d | {"segment_id": i} for i, (d, _) in enumerate(cases)])
    assert [r.route for r in decide.route(df).orderBy("segment_id").collect()] == [w for _, w in cases]
    hard = df.where("segment_id = 5")
    assert decide.route(hard, F.lit(1000.0), F.lit(900.0)).first().route == "sttn_fallback"


def test_retry_loop_carries_state(spark):
    first = spark.createDataFrame([(1,), (2,)], "segment_id long")
    seen = []

    def evaluate(segments, attempt):
        seen.append(segments.count())
        ok = (F.col("segment_id") == 1) & (F.lit(attempt) >= 1)
        return segments.select("segment_id", ok.alias("passed"), F.when(~ok, "expand_mask").alias("action"), (F.col("segment_id") * 1.0 - attempt / 10).alias("penalty"))

    out = decide.retry_loop(first, ["segment_id"], evaluate)
    best = {r.segment_id: r.attempt for r in decide.best_attempt(out, ["segment_id"]).collect()}
    assert seen == [2, 2, 1, 1, 1] and best[1] == 1 and best[2] == 4


def test_online_tracks_equal_the_batch(spark, sf_dir):
    from tessera.plans.all import QUERIES

    got, want = (sorted(map(tuple, QUERIES[n](spark, sf_dir).select("job_id", "shot_id", "det_id", "track_id").collect())) for n in ("j04_online_tracks", "e12_tracker"))
    assert got == want and len(want) > 100


def test_streams_lose_nothing_over_many_files(spark, sf_dir, tmp_path):
    """The same results from files in order of time, one a batch, as from one file."""
    from tessera.plans.all import QUERIES

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i, day in enumerate(range(1, 32, 6)):
        part = events.where(F.dayofmonth("ts").between(day, day + 5)).orderBy("ts").coalesce(1)
        part.write.parquet(f"{tmp_path}/raw{i}")
    target = tmp_path / "events.parquet"
    target.mkdir()
    for i in range(6):
        source = next((tmp_path / f"raw{i}").glob("*.parquet"))
        source.rename(target / f"part-{i}.parquet")
        import os

        os.utime(target / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    for name in ("j01_tumbling_counts", "j02_sliding_context", "j03_sessions", "j05_current_state", "j06_first_only"):
        got, want = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (str(tmp_path), sf_dir))
        assert got == want and want


def test_closing_rows_stay_out(spark, sf_dir):
    from tessera.plans.all import QUERIES

    rows = QUERIES["j01_tumbling_counts"](spark, sf_dir)
    assert rows.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert rows.where("user_id is null").isEmpty()


def _against_sql(spark, tmp_path, name, rows, schema, tables=("events",)):
    from tessera.plans.all import ORACLES, QUERIES

    for t in tables:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


def test_probe_of_no_seconds_and_of_unknown_ones(spark, tmp_path):
    _against_sql(spark, tmp_path, "a02_media_probe", [(i, v) for i, v in enumerate([0.0, -0.0, 0.0, 1.5, None, None, 0.0, 0.0000005, 0.0])] + [(18, None), (30, 3336.7), (42, -1.0), (54, 2.5), (66, 0.0000004)], "event_id long, value double")


def test_first_only_is_first_by_id_whatever_arrives_first(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(hours=i % 5), i % 3, "ab"[i % 2]) for i in range(40, 0, -1)] + [(41, None, 7, "a"), (2, at, 7, "a"), (3, None, None, "b")]
    _against_sql(spark, tmp_path, "j06_first_only", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")


def test_job_audit_streams_its_children(spark, tmp_path):
    """Keys of any number of rows: none is collected into one row. Rows without a second field are left out, as the SQL does."""
    from tessera.plans.all import ORACLES, QUERIES
    from tessera.plans.control import _CHILDREN

    for _, t, k, v in _CHILDREN:
        rows = [(i % 7000, None if i % 11 == 0 else (i * 7919) % 13) for i in range(30_000)] + [(None, 1), (15, None)]
        spark.createDataFrame(rows, f"{k} long, {v} int").write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for _, t, *_ in _CHILDREN:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["c17_job_audit"](spark, str(tmp_path))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    same(got, con, ORACLES["c17_job_audit"])
