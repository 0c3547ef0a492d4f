"""Engines over code facts: declared relations, derived relations, and the class library."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quarrylog.engine import Engine
from quarrylog.library import relations, rules
from quarrylog.plans import ir
from quarrylog.ql.datalog import parse_program


@lru_cache(maxsize=1)
def derived_rules() -> tuple[ir.Rule, ...]:
    return tuple(parse_program("\n".join([*rules.GROUPS.values(), rules.facts_text()])).rules)


def code_engine(spark: SparkSession, facts: dict[str, DataFrame] | None = None, **options) -> Engine:
    """An engine that knows all code relations (empty unless given in ``facts``) and the derived ones.

    A query evaluates only what it reaches.
    """
    engine = Engine(spark, **options)
    for name in relations.RELATIONS:
        engine.declare(name, relations.schema(name))
    for name, df in (facts or {}).items():
        if name in relations.RELATIONS and len(df.columns) != len(relations.RELATIONS[name]):
            raise ir.LogicError(f"{name} has {len(relations.RELATIONS[name])} columns, not {len(df.columns)}")
        engine.add_relation(name, df, distinct=True)
    return engine.add_rules(list(derived_rules()))


def read_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Relations stored as Parquet tables in a folder, one each, named after the relation."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)]
    return {os.path.splitext(n)[0]: spark.read.parquet(f"{folder}/{n}") for n in sorted(names) if not n.startswith(("_", "."))}
