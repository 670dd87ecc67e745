"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where none is set a local session gets a temporary one; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
    return _own_dir[0]


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written tables, which cut lineage and survive the loss of executors.

    ``drop`` removes one that is no longer read, ``clear`` all but some; the rest go when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._made = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        self._made.append(out)
        return out

    def clear(self, *kept: DataFrame | None) -> None:
        """Drops what was written here, but for ``kept``."""
        for df in self._made:
            if not any(df is k for k in kept):
                self.drop(df)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_tessera_path", None)
        if (self.spark, path) in _left:
            delete(self.spark, path)
            _left.remove((self.spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: nothing is left to ask
            return
