"""Control tables as append-only Parquet with latest-wins views. Writers may run side by side: each batch takes its place in a log, and readers see whole batches."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import jobs

#: Columns and key of each control table.
TABLES: dict[str, tuple[str, list[str]]] = {
    "jobs": ("job_id string, input_hash string, config_hash string, model_hash string, output string, priority int, state string", ["job_id"]),
    "media_probe": ("job_id string, probe string", ["job_id"]),
    "shots": ("job_id string, shot_id long, start_pts_us long, end_pts_us long, confidence double", ["job_id", "shot_id"]),
    "tracks": ("job_id string, track_id string, shot_id long, score double, class string", ["job_id", "track_id"]),
    "segments": ("job_id string, segment_id string, shot_id long, start_pts_us long, end_pts_us long, route string, engine string, state string", ["job_id", "segment_id"]),
    "quality_reports": ("job_id string, segment_id string, attempt long, passed boolean, action string, penalty double", ["job_id", "segment_id", "attempt"]),
    "model_runs": ("job_id string, segment_id string, attempt long, engine string, seconds double, peak_mb long", ["job_id", "segment_id", "attempt", "engine"]),
    "artifacts": ("job_id string, kind string, path string, sha256 string", ["job_id", "kind", "path"]),
    "events": ("event_id long, job_id string, to_state string, payload string", ["event_id"]),
}


class Conflict(RuntimeError):
    """Another writer came first."""


class Store:
    """Tables of batches under a log. A batch is written whole, then takes the next number of the log by creating its file, which only one writer can."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self, table: str) -> dict[int, str]:
        """The batches' folders by number."""
        path, fs = self._path(table, "_log")
        if not fs.exists(path):
            return {}
        # a log file's name is number and folder; the number alone must be new, see _take
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return {int(n): folder for n, _, folder in (x.partition("-") for x in names) if folder}

    def _take(self, table: str, number: int, folder: str) -> bool:
        path, fs = self._path(table, "_log", str(number))
        if fs.getUri().getScheme() == "file":  # where Hadoop looks before it creates, in two steps
            name = path.toUri().getPath()
            os.makedirs(os.path.dirname(name), exist_ok=True)
            try:
                os.close(os.open(name, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
        else:
            try:
                fs.create(path, False).close()
            except Exception as e:  # Py4J wraps whatever the file system throws
                if "AlreadyExists" in str(e):
                    return False
                raise
        fs.create(self._path(table, "_log", f"{number}-{folder}")[0], False).close()
        return True

    def _top(self, table: str) -> int:
        """The largest number taken."""
        path, fs = self._path(table, "_log")
        return max((int(x.getPath().getName().partition("-")[0]) for x in fs.listStatus(path)), default=0) if fs.exists(path) else 0

    def append(self, table: str, rows: DataFrame, after: int | None = None) -> int:
        """One batch; its number orders batches, so a later row of a key replaces an earlier one. With ``after``, only if that is still the last; else Conflict."""
        names = [c.split()[0] for c in TABLES[table][0].split(", ")]
        folder = uuid.uuid4().hex
        rows.select(*names).write.parquet(f"{self.root}/{table}/{folder}")
        while True:
            number = (self._top(table) if after is None else after) + 1
            if self._take(table, number, folder):
                return number
            if after is not None:
                raise Conflict(f"{table}: {number}")

    def log(self, table: str) -> DataFrame:
        """All rows with their batch's number as ``version``."""
        schema, entries = TABLES[table][0], self._entries(table)
        if not entries:
            return self.spark.createDataFrame([], schema + ", version long")
        numbers = self.spark.createDataFrame([(f, n) for n, f in entries.items()], "_folder string, version long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{f}" for f in entries.values()])
        rows = rows.withColumn("_folder", F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{32})/[^/]*$", 1))
        return rows.join(numbers, "_folder").drop("_folder")

    def latest(self, table: str) -> DataFrame:
        return jobs.latest(self.log(table), TABLES[table][1], [F.col("version")]).drop("version")

    def transition(self, job_id: str, to_state: str, payload: str | None = None, force: bool = False, patience: float = 30) -> int:
        """Appends an event and gives its id; fails where the state may not follow, unless forced. Of two writers one sees the other's event first."""
        until = time.monotonic() + patience
        while True:
            top, entries = self._top("events"), self._entries("events")
            if top and top not in entries:  # the last writer is between its two files
                if time.monotonic() > until:
                    raise TimeoutError(f"batch {top} of events was begun but not finished")
                time.sleep(0.02)
                continue
            now = self.log("events").where((F.col("job_id") == job_id) & (F.col("version") <= top)).agg(F.max_by("to_state", "event_id")).first()[0] or "discovered"
            if not force and now != to_state and to_state not in jobs.TRANSITIONS.get(now, []):
                raise ValueError(f"{now} -> {to_state}")
            try:
                return self.append("events", self.spark.createDataFrame([(top + 1, job_id, to_state, payload)], TABLES["events"][0]), after=top)
            except Conflict:
                continue

    def model_runs(self, job_id: str) -> DataFrame:
        return self.latest("model_runs").where(F.col("job_id") == job_id).orderBy("segment_id", "attempt", "engine")

    def quality_reports(self, job_id: str) -> DataFrame:
        return self.latest("quality_reports").where(F.col("job_id") == job_id).orderBy("segment_id", "attempt")
