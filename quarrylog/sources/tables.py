"""Parquet tables as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylog.engine import Engine

TEST_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def engine_over(spark: SparkSession, folder: str, *names: str, **options) -> Engine:
    """An engine with the named Parquet tables of a folder as stored relations."""
    engine = Engine(spark, **options)
    for name in names:
        engine.add_relation(name, read_table(spark, folder, name))
    return engine


def save_relations(engine: Engine, folder: str, *keys: tuple[str, int]) -> None:
    """Write derived or stored relations as one Parquet table each, with the relation's column names."""
    for name, arity in keys:
        df = engine.relation(name, arity)
        names = engine.columns.get(name)
        df = df.toDF(*names) if names and len(names) == arity else df
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
