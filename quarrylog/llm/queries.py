"""The registered queries of this subpackage: each runs an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import bpe, langid, linedup, matroska, neardup, packing, pseudonyms, quality, substrings, suffixes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The key of the registered queries, for the synthetic tables; real data takes its own from this setting.
PII_KEY, PII_SETTING = "synthetic tables only", "spark.quarrylog.pii.key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_SETTING, PII_KEY)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85, shingle=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir)))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pseudonyms.pseudonymise(docs, pii_key(spark), found="found")
    return found.select("doc_id", "text", "found", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(matroska.read_back(matroska.store(documents(spark, sf_dir))))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_windows(documents(spark, sf_dir), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.sample_texts(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeated_passages(documents(spark, sf_dir), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), min_lines=2, line_words=8)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_matroska": op5_matroska,
    "op6_substrings": op6_substrings,
    "op7_langid": op7_langid,
    "op8_quality": op8_quality,
    "op9_suffixes": op9_suffixes,
    "op10_linedup": op10_linedup,
}

def _windows_sql(window: int) -> str:
    """Words outside the windows that also start in a document with a smaller doc_id."""
    return rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - {window - 2})) AS i FROM texts WHERE len(words) >= {window}),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + {window - 1}), ' ') AS w FROM starts JOIN texts USING (doc_id)),
judged AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS earliest FROM windows),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM judged WHERE earliest < doc_id),
numbered AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM numbered ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""


ORACLES: dict[str, str] = {
    "op1_neardup": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM texts JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
    "op6_substrings": _windows_sql(13),
    "op9_suffixes": _windows_sql(50),
    "op10_linedup": r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
filled AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM split WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
pairs AS (
  SELECT doc_id, j, line, lead(line) OVER (PARTITION BY doc_id ORDER BY j) AS next FROM filled),
ranked AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, j) AS r
  FROM pairs WHERE next IS NOT NULL),
alone AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) AS r
  FROM filled WHERE len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) >= 8
    OR length(regexp_replace(line, '[ \t\n\x0B\f\r]+', '', 'g')) >= 40),
gone AS (
  SELECT doc_id, j FROM ranked WHERE r > 1 UNION SELECT doc_id, j + 1 FROM ranked WHERE r > 1
  UNION SELECT doc_id, j FROM alone WHERE r > 1),
gone_lines AS (SELECT doc_id, i FROM filled JOIN gone USING (doc_id, j)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM split ANTI JOIN gone_lines USING (doc_id, i) GROUP BY doc_id),
numbers AS (
  SELECT doc_id, count(*) AS n_lines FROM filled GROUP BY doc_id),
removed AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN numbers USING (doc_id) LEFT JOIN removed USING (doc_id)
""",
}
