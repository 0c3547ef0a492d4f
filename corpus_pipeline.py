"""From raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. run() applies them in order to the table documents, and
writes each stage's result as Parquet in the shared scratch folder, where the
next one reads it as its docs. All stages but the last return the columns of
documents (and any further ones that docs has); n_chars follows the text.

- language: learns from the labelled rows and drops documents in no known
  language: without a letter, or with an entropy beyond MOST_BITS (or MOST_OWN,
  for scripts of many letters) under every language. Null and empty texts go here.
- lines: drops later copies of runs of two lines or more, and of single lines of
  LINE_WORDS words or more; a document that loses all its lines goes, as earlier
  ones hold them.
- near_duplicates: keeps the document with the smallest doc_id of each component.
- private: replaces personal data and secrets by pseudonyms.
- packing: returns pieces of sequences; see quarrylog.llm.packing.

Stages that run Python take their rows in Arrow batches of at most BATCH_ROWS, so
that an executor's memory outside the heap stays bounded. As results are lazy, the
session keeps that setting; one that is already smaller stays.

Rows with a null doc_id pass all stages as documents of their own. Repeated rows
stay repeated, as they are one document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import langid, linedup, neardup, packing, pseudonyms
from quarrylog.llm.columns import free_prefix
from quarrylog.llm.queries import pii_key
from quarrylog.llm.scratch import Scratch, release

#: Bits a character; text in a known language takes 3 to 5, unknown scripts over 10.
MOST_BITS = 8.0
#: Scripts of thousands of letters take more: so many times what one half of the language's sample takes under the other.
MOST_OWN = 1.25
#: A repeated line of so many words goes whatever its neighbours; shorter ones (headings, labels) only within a longer run.
LINE_WORDS = 8
#: Rows that go to Python at a time.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows go to Python at a time (0 or less would be without a limit)."""
    now = int(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    own = free_prefix(docs.columns)
    found = langid.predict(docs, langid.sample_texts(docs), carry=docs.columns, prefix=own, own=True)
    return found.where(F.col(f"{own}bits") <= F.greatest(F.lit(MOST_BITS), MOST_OWN * F.col(f"{own}own"))).select(*(f"`{c}`" for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = free_prefix(docs.columns)
    kept = linedup.drop_repeated_lines(docs, min_lines=2, prefix=own, line_words=LINE_WORDS)
    emptied = (F.col(f"{own}n_removed") > 0) & (F.col(f"{own}n_removed") == F.col(f"{own}n_lines"))
    return with_length(kept.where(~emptied).select(*(f"`{c}`" for c in docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    gone = neardup.near_duplicates(docs, percent=80, shingle=5).where(~F.col("kept")).select("doc_id")
    return docs.join(gone.distinct().hint("merge"), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return with_length(pseudonyms.pseudonymise(docs, pii_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("private", private), ("packing", pack)]
#: Entropies, sketches, pseudonyms and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
