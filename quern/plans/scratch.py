"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

Lineage is cut by writing Parquet there, which survives the loss of executors. A folder of our own is
made only where the setting is absent (tests, local runs).
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
ROWS_PER_FILE = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in a local session without it, a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quern-scratch-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


class Scratch:
    """Named tables of one operator call. drop() removes a table that nothing reads any more; what is
    left goes when the JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str, rows: int | None = None, codec: str = "zstd") -> DataFrame:
        """rows: how many there are at most, about; a small table then becomes few files."""
        self._n += 1
        if rows is not None:
            df = df.coalesce(max(1, rows // ROWS_PER_FILE))
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """A small or short-lived table on the executors' disks. Unlike a local checkpoint it has its
        lineage: what a lost executor held is computed again."""
        return df.persist(StorageLevel.DISK_ONLY)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if hasattr(df, "_quern_path"):
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._quern_path), True)
            else:
                df.unpersist()

    def sweep(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now, not at the driver's next garbage
        collection: a long operator would else hold the files of all its steps."""
        gc.collect()
        self.spark._jvm.System.gc()


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of an eager step."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
