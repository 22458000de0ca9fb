"""Session plumbing: table loading and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    A machine-local folder is made only where the setting is absent and all of Spark runs in one process, as in
    tests; it is removed when the interpreter ends. On a cluster without the setting a RuntimeError is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="kinfold-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


class Scratch:
    """Tables written to the shared folder to cut lineage between the steps of one operator.

    `keep` writes a DataFrame and returns it read back: a lost executor then costs a re-read, never a
    recomputation of the whole chain. `drop` removes a table that no later step reads. What is left
    when the session ends is removed by the file system's delete-on-exit hook.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str = "snappy"):
        self.spark, self.codec = spark, codec
        self.root = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        at = f"{self.root}/t{self._n}"
        # The shuffle files of the step go as soon as it is written, not when the driver happens to collect its garbage.
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", self.codec).parquet(at)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._kept_at = at
        return out

    def drop(self, df: DataFrame) -> None:
        self._fs.delete(self._path(df._kept_at), True)

    def settle(self) -> None:
        """Has Spark remove the shuffle files of steps that ended, which stay until the driver collects the garbage that refers to them."""
        gc.collect()
        self.spark._jvm.System.gc()


def small(df: DataFrame, bound: int = 1 << 20) -> DataFrame:
    """The same rows, marked for broadcasting if they are counted to be no more than `bound`; for narrow tables that are cheap to count."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
