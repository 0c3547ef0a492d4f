"""Cutting the lineage of iterated and shared tables."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Jobs that one evaluation has at work at a time.
JOBS = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where it is unset and all tasks run in this process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrylog-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Workspace:
    """Tables of one evaluation, written as Parquet where all executors can read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self._root, self._paths, self._written = spark, None, {}, 0

    def settle(self, df: DataFrame) -> DataFrame:
        """Write df and return a DataFrame over what was written."""
        return self.settle_all([df])[0][0]

    def settle_all(self, tables: list[DataFrame]) -> list[tuple[DataFrame, int]]:
        """Write independent tables side by side; DataFrames over what was written, and their rows as counted on the way."""
        if self._root is None:
            self._root = f"{shared_folder(self.spark)}/logic-{uuid.uuid4().hex[:12]}"
        paths = [f"{self._root}/{self._written + i:04d}" for i in range(len(tables))]
        self._written += len(tables)

        def write(df: DataFrame, path: str) -> tuple[DataFrame, int]:
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

        if len(tables) == 1:
            done = [write(tables[0], paths[0])]
        else:
            with ThreadPoolExecutor(JOBS) as pool:
                # each thread's jobs carry this one's tags, so that an interrupt reaches them
                done = [job.result() for job in [pool.submit(inheritable_thread_target(self.spark)(write), t, p) for t, p in zip(tables, paths, strict=True)]]
        for path, (out, _) in zip(paths, done, strict=True):
            self._paths[id(out)] = (path, out)
        return done

    def forget(self, df: DataFrame) -> None:
        """Delete a table that settle() wrote and nothing reads any more."""
        if found := self._paths.get(id(df)):
            self._delete(found[0])

    def close(self) -> None:
        """Delete all tables; what reads them must be done."""
        if self._root:
            self._delete(self._root)
            self._root, self._paths = None, {}

    def _delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
