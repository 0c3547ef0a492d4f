"""Derived relations that follow streams of facts.

Monotone programs (without negation and aggregates) are kept up to date by
deltas: each micro-batch of new facts joins with what is stored, and only new
tuples are derived and appended. Other programs are evaluated anew from all
facts stored so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarrylog.engine import Engine
from quarrylog.plans import analysis, ir


class View:
    """A derived relation over stored facts in a folder, updated batch by batch."""

    def __init__(self, spark: SparkSession, program: str, name: str, arity: int, relation: str, folder: str):
        from quarrylog.ql.datalog import parse_program

        self.spark, self.name, self.arity, self.relation, self.folder = spark, name, arity, relation, folder
        self.rules = parse_program(program).rules
        self.monotone = not any(below for r in self.rules for _, below in ir.dependencies(ir.Rule(r.head, analysis.normal(r.body))))

    def _facts(self) -> str:
        return f"{self.folder}/facts"

    def _derived(self, version: int) -> str:
        return f"{self.folder}/derived/{version}"

    def apply(self, batch: DataFrame, version: int) -> None:
        """Store a batch of facts and write the relation as of this version; repeating a version gives the same."""
        batch.distinct().write.mode("overwrite").parquet(f"{self._facts()}/version={version}")
        facts = self.spark.read.parquet(self._facts()).where(f"version <= {version}").drop("version")
        engine = Engine(self.spark).add_relation(self.relation, facts, distinct=True).add_rules(self.rules)
        if self.monotone and version > 0:
            known = self.spark.read.parquet(self._derived(version - 1))
            engine.add_relation(self.name, known)  # the fixpoint goes on from here
        engine.relation(self.name, self.arity).write.mode("overwrite").parquet(self._derived(version))

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply the micro-batches of a stream of facts."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._derived(version))
