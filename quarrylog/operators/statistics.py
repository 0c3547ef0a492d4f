"""Table statistics: row counts, distinct values, frequent values, histograms, join selectivity.

One pass a table for counts and quantiles of all columns; frequent values are
counted exactly, by a grouped count and a top-k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, TOP, LEAST_DISTINCT = 64, 32, 256
SCHEMA = "relation string, column string, rows long, distinct_values long, null_fraction double, histogram array<double>"


def column_statistics(name: str, df: DataFrame, error: float = 0.02) -> DataFrame:
    """relation, column, rows, distinct_values (HyperLogLog), null_fraction, histogram (bounds of equal-height buckets)."""
    measures = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, T.NumericType)
        points = F.percentile_approx(c.cast("double"), [k / BUCKETS for k in range(BUCKETS + 1)], 10_000) if numeric else F.lit(None).cast("array<double>")
        measures += [F.approx_count_distinct(c, error).alias(f"d{i}"), F.count(c).alias(f"n{i}"), points.alias(f"h{i}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *measures)
    rows = F.greatest("rows", F.lit(1))
    parts = [
        F.struct(
            F.lit(name).alias("relation"), F.lit(f.name).alias("column"), F.col("rows"), F.col(f"d{i}").alias("distinct_values"),
            (1 - F.col(f"n{i}") / rows).alias("null_fraction"), F.when(F.col(f"d{i}") >= LEAST_DISTINCT, F.col(f"h{i}")).alias("histogram"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def frequent_values(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """value (as text) and count of the k most frequent values; ties by value."""
    value = F.col(f"`{column}`").cast("string").alias("value")
    return df.select(value).where("value IS NOT NULL").groupBy("value").count().orderBy(F.desc("count"), "value").limit(k)


def join_selectivity(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """rows and matched: how many rows of left find a partner in right."""
    keys = right.select(F.col(f"`{right_column}`").alias("k")).distinct().withColumn("hit", F.lit(1))
    both = left.select(F.col(f"`{left_column}`").alias("k")).join(keys, "k", "left")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("matched"))


def compute(spark: SparkSession, relations: dict[str, DataFrame]) -> DataFrame:
    """column_statistics of all relations."""
    parts = [column_statistics(n, df) for n, df in relations.items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def sample_join_size(left: DataFrame, right: DataFrame, on: list[str], fraction: float, seed: int = 7) -> DataFrame:
    """An estimate of the size of a join, from a sample of the left side's rows against all of the right's."""
    return left.sample(fraction=fraction, seed=seed).join(right.groupBy(*on).count(), on).agg((F.coalesce(F.sum("count"), F.lit(0)) / F.lit(fraction)).alias("estimate"))
