"""Joins whose result is far larger than their inputs, dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side with one key that stay together.
ROWS = 4096


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Natural inner join on ``on``. A key with many rows on a side is cut into blocks there, and its rows
    on the other side are repeated for each, so that a task joins blocks with blocks; each side's repeats are at most a row for
    every ROWS of the result."""
    cuts = {"__l": _blocks(left, on, "__l"), "__r": _blocks(right, on, "__r")}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        # at most one key for every ROWS rows, so small enough to be sent to all tasks
        for cut in cuts.values():
            df = df.join(F.broadcast(cut), on, "left")
        names = [c for c in df.columns if c not in cuts]
        block = F.pmod(F.xxhash64(*names), F.coalesce(own, F.lit(1))).cast("int")
        return df.select(*names, block.alias(f"{own}_at"), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(f"{other}_at"))

    keys = [*on, "__l_at", "__r_at"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of tasks, since by their size small inputs would be dealt to few
    return dealt(left, "__l", "__r").repartition(tasks, *keys).join(dealt(right, "__r", "__l").select(*keys, *(c for c in right.columns if c not in on)), keys).drop("__l_at", "__r_at")


def _blocks(df: DataFrame, on: list[str], name: str) -> DataFrame:
    """Keys with more than ROWS rows, and into how many blocks these are cut."""
    return df.groupBy(*on).count().where(F.col("count") > ROWS).select(*on, F.ceil(F.col("count") / ROWS).cast("int").alias(name))
