"""Materialised intermediate tables, kept where every executor can read them.

A stage that is read more than once, or that ends an iteration, is written as
Parquet under the folder the cluster names in ``spark.checkpoint.dir``. That
cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two looks for unreachable shuffles.
RELEASE_SECONDS = 5
_released = 0.0


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a local one only where none is set and all tasks run in this process."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quarrylog-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """A folder of intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return a DataFrame that reads what was written."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that save() wrote and let Spark clear the shuffles behind them."""
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                remove(self.spark, path)
        release(self.spark)


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice unreachable shuffles, so that executors drop their files; at most every few seconds."""
    global _released
    if time.monotonic() - _released > RELEASE_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _released = time.monotonic()
