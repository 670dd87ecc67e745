"""Structured Streaming over event and frame streams. Each takes a streaming (or batch) DataFrame with a timestamp column ``ts``.

A stream has no end, so windows, sessions and tracks stay open until the watermark passes them. ``drain`` ends a bounded one: after
its last file come closing rows, whose far-off times carry the watermark past all that is open. Results go to files.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, TimestampType

from tessera.operators.tracking import Tracker, track_name
from tessera.sources.shared import new_path

#: Rows at this time and later only close a stream.
CLOSING = "2250-01-01"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, table: str = "events", ts: Column | None = None, closing: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, ``ts`` with time zone (watermarks need it); files in the folder ``closing`` are read too, and last."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    schema = type(schema)([*schema.fields, StructField("_closing", TimestampType())])
    at = f"{path}/{table}.parquet"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    stream = stream.parquet(_either(spark, at, closing) if closing else at)
    return stream.withColumn("ts", F.coalesce("_closing", (F.col("ts") if ts is None else ts).cast("timestamp"))).drop("_closing")


def _either(spark: SparkSession, *paths: str) -> str:
    """One glob for paths of one file system, as a stream has one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    whole = [p.getFileSystem(conf).makeQualified(p).toUri() for p in whole]
    roots = {(u.getScheme(), u.getAuthority()) for u in whole}
    if len(roots) > 1:
        raise ValueError("the stream's files and spark.checkpoint.dir must be on one file system")
    scheme, authority = roots.pop()
    return f"{scheme}://{authority or ''}/{{{','.join(u.getPath().lstrip('/') for u in whole)}}}"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """With the watermark, which closing rows carry on; they themselves go."""
    return events.withWatermark("ts", late).where(F.col("ts") < F.lit(CLOSING).cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, key: str = "user_id") -> DataFrame:
    return _timed(events, late).groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(key, F.unix_micros("w.start").alias("start_us"), "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str, key: str = "event_type") -> DataFrame:
    return _timed(events, late).groupBy(key, F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(key, F.unix_micros("w.start").alias("start_us"), "n", "top")


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    """Runs of events of a key with no gap of over ``gap``, each closed once the watermark has passed its end."""
    runs = _timed(events, late).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return runs.select(key, F.unix_micros("s.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def current_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    return events.groupBy(key).agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("since"))


def first_only(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """Of each key's events the first in ``order``, in update mode: a smaller one that arrives later takes its place.

    Dropping duplicates as they arrive would keep whichever row a file or a task happens to bring first.
    """
    return events.groupBy(*keys).agg(F.min(order).alias(order)).select(order, *keys)


_CLOSING_MS = pd.Timestamp(CLOSING).value // 10**6
_BOXES = ["frame_index", "det_id", "x1", "y1", "x2", "y2", "angle", "look0", "look1", "look2"]


class _Tracks(StatefulProcessor):
    """Holds a shot's detections until the watermark has passed their frame, then feeds whole frames to the tracker in order."""

    def __init__(self, key: list[str], width: int, height: int):
        self.key, self.size = key, (width, height)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} double" if c.startswith(("angle", "look")) else f"{c} long" for c in ["ms", *_BOXES]))
        self.tracker = handle.getValueState("tracker", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            ms = batch["ts"].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList([(int(t), *(float(v) if i > 5 else int(v) for i, v in enumerate(r))) for t, r in zip(ms, batch[_BOXES].itertuples(index=False, name=None), strict=True)])
            self.handle.registerTimer(int(ms.max()) + 1)
        self.handle.registerTimer(_CLOSING_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        every = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in every if r[0] < passed], [r for r in every if r[0] >= passed]
        tracker = Tracker(*self.size)
        if self.tracker.exists():
            tracker.restore(pickle.loads(self.tracker.get()[0]))
        closed: list[list[int]] = []
        at = 0
        while at < len(ready):
            stop = next((i for i in range(at, len(ready)) if ready[i][1] != ready[at][1]), len(ready))
            rows = np.array([r[2:] for r in ready[at:stop]], float)
            closed += tracker.step(ready[at][1], [r[2] for r in ready[at:stop]], rows[:, 1:5].astype(np.int64), rows[:, 5], rows[:, 6:9])
            at = stop
        if passed < _CLOSING_MS:
            self.tracker.update((pickle.dumps(tracker.state()),))
        else:
            closed += tracker.finish()
            self.tracker.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(r[0] for r in rest) + 1)
        else:
            self.waiting.clear()
        rows = [(*key, d, track_name(members[0])) for members in closed for d in members]
        yield pd.DataFrame(rows, columns=[*self.key, "det_id", "track_id"])

    def close(self) -> None:
        pass


def online_tracks(detections: DataFrame, late: str, key: list[str], width: int = 1920, height: int = 1080) -> DataFrame:
    """key, det_id, track_id as ``tracking.track`` gives them, each track once it has ended. ``detections``: key, ts, and the columns of a box."""
    kinds = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in key)
    seen = _timed(detections, late).select(*key, "ts", *_BOXES)
    return seen.groupBy(*key).transformWithStateInPandas(_Tracks(key, width, height), f"{kinds}, det_id long, track_id string", "append", "eventTime")


def _run(stream: DataFrame, state: str, mode: str, sink) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    sink(writer).start().awaitTermination()


def drain(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], table: str = "events", ts: Column | None = None, closes: int = 2) -> DataFrame:
    """All that ``make``, of an append stream, gives for a table's files from first to last, closed by ``closes`` rows, one a batch."""
    folder = new_path(spark)
    closing, state, out = f"{folder}/closing", f"{folder}/state", f"{folder}/out"
    sink = lambda w: w.format("parquet").option("path", out)
    for i in range(closes + 1):
        if i:
            late = spark.range(1).select(F.expr(f"timestamp '{CLOSING}' + make_interval(0, 0, 0, {i})").alias("_closing"))
            late.coalesce(1).write.mode("append").parquet(closing)
        else:
            spark.range(0).select(F.lit(None).cast("timestamp").alias("_closing")).write.parquet(closing)
        stream = make(read(spark, path, table, ts, closing))
        _run(stream, state, "append", sink)
    return spark.read.schema(stream.schema).parquet(out)


def latest(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], key: list[str], table: str = "events") -> DataFrame:
    """The last row for each ``key`` of an update stream, run to the end of a table's files; each batch is a written table."""
    folder = new_path(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream = make(read(spark, path, table))
    _run(stream, f"{folder}/state", "update", lambda w: w.foreachBatch(keep))
    rest = [c for c in stream.columns if c not in key]
    rows = spark.read.option("basePath", f"{folder}/out").schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*").select(*stream.columns[: len(key) + len(rest)])
