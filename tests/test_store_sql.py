import pytest

from tessera.functions import sql
from tessera.operators.engines import ModelUnavailable
from tessera.sources import external
from tessera.sources.store import TABLES, Conflict, Store


def test_sql_functions(spark):
    assert sql.register(spark)
    row = spark.sql("select box_iou(0, 0, 10, 10, 5, 0, 15, 10) a, box_iou(0, 0, 0, 0, 0, 0, 0, 0) b, clip01(1.5) c, micros_of_seconds('1.5') d, micros_of_seconds('N/A') e").first()
    assert (round(row.a, 6), row.b, row.c, row.d, row.e) == (0.333333, 0.0, 1.0, 1_500_000, 0)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.latest("shots").count() == 0
    for confidence in (0.5, 0.9):
        s.append("shots", spark.createDataFrame([("j", 0, 0, 100, confidence), ("j", 1, 100, 200, confidence)], TABLES["shots"][0]))
    assert [r.confidence for r in s.latest("shots").collect()] == [0.9, 0.9] and s.log("shots").count() == 4
    s.transition("j", "probed")
    with pytest.raises(ValueError):
        s.transition("j", "done")
    s.transition("j", "done", force=True)
    assert s.latest("events").count() == 2


def test_of_two_writers_one_comes_first(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda i: spark.createDataFrame([(i, "j", "probed", None)], TABLES["events"][0])
    assert s.append("events", rows(1), after=0) == 1
    with pytest.raises(Conflict):
        s.append("events", rows(2), after=0)
    assert s.append("events", rows(2)) == 2 and s.log("events").count() == 2


def test_transitions_of_many_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def go(i):
        return Store(spark, str(tmp_path)).transition(f"j{i % 3}", "probed")

    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(go, range(8)))
    log = Store(spark, str(tmp_path)).log("events").collect()
    assert sorted(ids) == list(range(1, 9)) == sorted(r.event_id for r in log) == sorted(r.version for r in log)


def test_one_of_two_conflicting_transitions_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    first = Store(spark, str(tmp_path))
    first.transition("j", "cancelled", force=True)

    def go(_):
        try:
            Store(spark, str(tmp_path)).transition("j", "probed")
            return True
        except ValueError:
            return False

    with ThreadPoolExecutor(2) as pool:
        assert not any(pool.map(go, range(2)))
    assert first.log("events").count() == 1


def test_listings(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    runs = [("j", "s2", 0, "lama", 1.0, 10), ("j", "s1", 1, "telea", 1.0, 10), ("j", "s1", 0, "telea", 2.0, 10), ("k", "s1", 0, "telea", 2.0, 10)]
    s.append("model_runs", spark.createDataFrame(runs, TABLES["model_runs"][0]))
    s.append("model_runs", spark.createDataFrame([("j", "s1", 1, "telea", 9.0, 11)], TABLES["model_runs"][0]))
    assert [(r.segment_id, r.attempt, r.seconds) for r in s.model_runs("j").collect()] == [("s1", 0, 2.0), ("s1", 1, 9.0), ("s2", 0, 1.0)]
    assert s.quality_reports("j").count() == 0


def test_absent_programs_say_so():
    with pytest.raises(ModelUnavailable):
        external.Tool("no-such-program-here").run()


def test_encoding_attempts(tmp_path):
    here = {"h264_nvenc", "libx264", "aac", "libsvtav1", "libopus"}
    ways = external.attempts("h264", "mp4", here)
    assert [(a.encoder, a.audio) for a in ways] == [("h264_nvenc", "copy"), ("libx264", "copy"), ("libx264", "aac")]
    assert [(a.encoder, a.audio) for a in external.attempts("av1", "webm", here, "libopus")] == [("libsvtav1", "libopus")]
    assert external.attempts("h265", "mp4", here) == [] and [a.encoder for a in external.attempts("h264", "mp4", {"libx264"})] == ["libx264"]

    class Program(external.Tool):
        asked: list = []

        def works(self, *args):
            self.asked.append(args)
            with open(args[-1], "w") as f:
                f.write("x")
            return "aac" in args

    done = external.encode("c", "s", str(tmp_path / "out.mp4"), "h264", "mp4", tool=Program("none"), here=here)
    assert done == ways[2] and len(Program.asked) == 3 and [p.name for p in tmp_path.iterdir()] == ["out.mp4"]
    with pytest.raises(RuntimeError):
        external.encode("c", "s", str(tmp_path / "no.mkv"), "h264", "matroska", tool=Program("none"), here={"libx264"})
    assert external.device_memory() is None or len(external.device_memory()) == 4
