"""Repeated word windows, found with a log-structured fingerprint index.

A fingerprint is the smallest gram hash of a window (a minimiser): equal windows
have equal fingerprints, and neighbouring windows mostly share theirs, so a text
has about one fingerprint for five words. The index is a folder of immutable runs:
postings (fingerprint, doc_id), dealt into buckets and sorted by fingerprint in
each, and the texts. A batch of documents becomes a new run, which is
merge-joined with the runs before it, bucket by bucket and without a shuffle.
Fingerprints that two documents share lead back to the texts, where windows at
just these places are verified by 128-bit BLAKE2b digests of their words. When there are
``fanout`` runs, they are compacted into one before the next batch meets them.
An index opened again in a later session goes on with the next batch.

Exact copies of earlier texts (by SHA-256) are set aside first: all their windows start in the
original, so they need no fingerprints, and neither do texts that nothing but
their copies repeat. The other texts are kept bucketed by doc_id, so that looking
at windows and cutting words takes no further shuffle of texts.

Batches are taken in the order of doc_id, so that what a document repeats is
either in the runs or in its own batch. A word goes if a window covers it that
also starts in a document with a smaller doc_id; windows are judged on the input.

Null texts have no words. Rows with a null doc_id stay whole and take nothing
from others. Rows that share a doc_id are one document.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import textcols as tc
from quarrylog.llm.minimisers import selected
from quarrylog.llm.scratch import Scratch, release, remove
from quarrylog.llm.skew import join_groups, union_all


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, fp: the distinct fingerprints of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()), np.int64)
            for part in tc.slices(batch.column("text")):
                begin, end, first = part.words()
                _, at, grams = selected(tc.word_hashes(part.data, begin, end), first, window, gram)
                at = np.unique(at)
                owner = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[part.first + owner]), pa.array(grams[at].view(np.int64))], names=["doc_id", "fp"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _wanted(starts: np.ndarray, at: np.ndarray, grams: np.ndarray, first: np.ndarray, fps: pa.ListArray) -> np.ndarray:
    """Is a window's fingerprint, grams[at], among its document's fps?

    Neighbouring windows share their place, so each place is looked up once, and
    those of all documents at once. Fingerprints are mixed with the document's
    number; if two should meet, a window more is compared.
    """
    if not len(starts):
        return np.zeros(0, bool)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    places = at[new]
    salt = tc.mix(np.arange(len(fps), dtype=np.uint64))
    lists = np.repeat(salt, np.diff(np.asarray(fps.offsets)))
    sought = grams[places] ^ salt[np.searchsorted(first, places, "right") - 1]
    found = np.isin(sought, np.asarray(fps.flatten()).view(np.uint64) ^ lists)
    return found[np.cumsum(new) - 1]


def windows_at(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, at, w1, w2: start and digest of the words of the windows of docs(doc_id, text, fps) whose fingerprint is among fps."""
    names = ["doc_id", "at", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()), np.int64)
            for part in tc.slices(batch.column("text")):
                begin, end, first = part.words()
                starts, at, grams = selected(tc.word_hashes(part.data, begin, end), first, window, gram)
                keep = _wanted(starts, at, grams, first, batch.column("fps").slice(part.first, part.n))
                starts = starts[keep]
                owner = np.searchsorted(first, starts, "right") - 1
                # only words under these windows are looked at
                cover = np.zeros(len(begin) + 1, np.int32)
                cover[starts] += 1
                cover[starts + window] -= 1
                under = np.cumsum(cover[:-1]) > 0
                plain, byte = tc.plain_words(part.data, begin[under], end[under])
                place = (np.cumsum(under) - 1)[starts]
                spans = zip(byte[place].tolist(), byte[place + window].tolist(), strict=True)
                digests = np.frombuffer(b"".join([hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in spans]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part.first + owner]), pa.array((starts - first[owner]).astype(np.int32)), pa.array(digests[::2]), pa.array(digests[1::2])], names=names)

    return docs.select("doc_id", "text", "fps").mapInArrow(run, "doc_id long, at int, w1 long, w2 long")


def without_spans(docs: DataFrame, spans: DataFrame, window: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of docs(doc_id, text) outside spans(doc_id, start, stop), joined by blanks.

    spans gives for each doc_id lists of first words and of words after the last.
    Where docs has a column copy that is true, all words go if there are ``window`` of them.
    """
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                sizes, gone, kept = [], [], []
                for text, copy, start, stop in zip(*(batch.column(c) for c in ("text", "copy", "start", "stop")), strict=True):
                    words = (text.as_py() or "").encode().split()
                    n = len(words)
                    if copy.as_py() and n >= window:
                        words = []
                    elif start.is_valid and n:
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, np.asarray(start.values), 1)
                        np.add.at(cover, np.asarray(stop.values), -1)
                        stay = np.cumsum(cover[:n]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    sizes.append(n)
                    gone.append(n - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=names)

    copy = F.col("copy") if "copy" in docs.columns else F.lit(False).alias("copy")
    joined = docs.select("doc_id", "text", copy).join(spans.hint("merge"), "doc_id", "left").select("doc_id", "text", "copy", "start", "stop")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def exact_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id of texts that a smaller doc_id has too."""
    heads = scratch.save(docs.where("text IS NOT NULL").select("doc_id", F.unhex(F.sha2("text", 256)).alias("h")), "heads")
    groups = heads.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("size")).where("a <> b").drop("b")
    return join_groups(heads, scratch.save(groups, "copied"), ["h"]).where("doc_id > a").select("doc_id").distinct()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting has this value inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sorted_buckets(spark: SparkSession):
    """Plans made inside take buckets of one sorted file as sorted, so that merge joins of runs sort nothing anew."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def presorted(spark: SparkSession):
    """Plans of writes made inside keep a sort by the key alone, which goes by digits, before the writer's sort by the
    bucket's number and the key, which compares rows and then finds them in order."""
    return setting(spark, "spark.sql.optimizer.plannedWrite.enabled", "false")


class Bucketed:
    """Parquet tables in a folder, dealt into buckets by a key and sorted by it; none stays in the session's catalogue."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._tables = spark, folder, {}

    def write(self, df: DataFrame, key: str, buckets: int) -> str:
        name = f"run_{uuid.uuid4().hex[:12]}"
        dealt = df.repartition(buckets, key).sortWithinPartitions(key)
        with presorted(self.spark):
            dealt.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self._tables[name] = self._uncatalogued(name)
        release(self.spark)
        return name

    def read(self, name: str, schema: str, key: str, buckets: int) -> DataFrame:
        """A table that write() wrote, in this session or another."""
        if name not in self._tables:
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self._tables[name] = self._uncatalogued(name)
        return self._tables[name]

    def _uncatalogued(self, name: str) -> DataFrame:
        """The table as a DataFrame; the files stay when the catalogue forgets it."""
        table = self.spark.table(name)
        table.schema  # noqa: B018 - looked up while the catalogue has it
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def drop(self, name: str) -> None:
        self._tables.pop(name, None)
        remove(self.spark, f"{self.folder}/{name}")


def default_buckets(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def marked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text, copy of all rows with a doc_id; copy: an earlier document has the same text."""
    known = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    copies = scratch.save(exact_copies(known, scratch), "copies")
    return known.join(copies.withColumn("c", F.lit(True)).hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("c", F.lit(False)).alias("copy"))


def marked_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """marked(docs), written bucketed by doc_id."""
    tables, buckets = Bucketed(docs.sparkSession, scratch.root), default_buckets(docs.sparkSession)
    return tables.read(tables.write(marked(docs, scratch), "doc_id", buckets), TEXTS, "doc_id", buckets)


POSTINGS, TEXTS = "cell BIGINT, fp BIGINT, doc_id BIGINT", "doc_id BIGINT, text STRING, copy BOOLEAN"
#: Postings of a bucket before compaction deals them into more buckets.
BUCKET_ROWS = 8_000_000
#: Tables of texts that an index has before compaction merges them.
TEXT_TABLES = 8
#: A fingerprint in more than one of PARTS documents of a sample is spread over CELLS buckets; MOST_FREQUENT of a batch at most.
PARTS, CELLS, MOST_FREQUENT = 50, 64, 500


class FingerprintIndex:
    """A folder of immutable runs of postings (cell, fp, doc_id) and the texts they came from.

    What belongs to the index is written in numbered manifests; the newest counts, so
    that a later session that opens the folder goes on where the last one stopped.
    Buckets go by cell: the fingerprint, or for frequent ones the fingerprint with a
    part of the doc_id; only those are stored besides the cell. Which are frequent is found on a sample of each batch; it
    decides on the layout alone, not on what is found.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = 13, gram: int = 5, buckets: int | None = None, fanout: int = 2):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = Bucketed(spark, self.folder)
        self.state = self._newest() or {"version": 0, "window": window, "gram": gram, "fanout": fanout, "buckets": buckets or default_buckets(spark), "runs": [], "texts": [], "frequent": []}
        self.window, self.gram, self.fanout = (self.state[k] for k in ("window", "gram", "fanout"))

    @property
    def runs(self) -> list[str]:
        return [r["name"] for r in self.state["runs"]]

    def _newest(self) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = sorted(p.toString() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        return json.loads(self.spark.read.text(done[-1], wholetext=True).first()[0]) if done else None

    def _commit(self, **changes) -> None:
        """A new manifest; what it no longer names is deleted after it is written."""
        before = {t["name"] for k in ("runs", "texts") for t in self.state[k]}
        self.state = {**self.state, **changes, "version": self.state["version"] + 1}
        self.spark.createDataFrame([(json.dumps(self.state),)], "m string").coalesce(1).write.text(f"{self.folder}/manifests/{self.state['version']:08d}")
        for name in before - {t["name"] for k in ("runs", "texts") for t in self.state[k]}:
            self.tables.drop(name)

    def _write(self, df: DataFrame, key: str) -> dict:
        """A run or a table of texts, with what the manifest says about it."""
        return {"name": self.tables.write(df, key, self.state["buckets"]), "buckets": self.state["buckets"]}

    def _table(self, entry: dict, key: str) -> DataFrame:
        table = self.tables.read(entry["name"], POSTINGS if key == "cell" else TEXTS, key, entry["buckets"])
        return table.select("cell", F.coalesce("fp", "cell").alias("fp"), "doc_id") if key == "cell" else table

    def texts(self) -> list[DataFrame]:
        """doc_id, text, copy of all documents, in tables bucketed by doc_id."""
        return [self._table(t, "doc_id") for t in self.state["texts"]]

    def _frequent(self, batch: DataFrame) -> list[int]:
        """Fingerprints in one of PARTS documents of a sample or more, at most MOST_FREQUENT."""
        some = batch.sample(0.01, 20).select("doc_id", "text")
        found = fingerprints(some, self.window, self.gram).select("fp").union(some.select(F.lit(None).cast("long")))
        counts = found.groupBy("fp").count().where("count > 3").orderBy(F.col("fp").isNotNull(), F.desc("count"), "fp").limit(MOST_FREQUENT + 1).collect()
        # the null one, which every document has, comes first
        return [r["fp"] for r in counts[1:] if r["count"] * PARTS > counts[0]["count"]]

    def _with_cells(self, postings: DataFrame, frequent: list[int]) -> DataFrame:
        spread = F.xxhash64("fp", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
        if not frequent:
            return postings.select(F.col("fp").alias("cell"), F.lit(None).cast("long").alias("fp"), "doc_id")
        many = F.col("fp").isin(frequent)
        return postings.select(F.when(many, spread).otherwise(F.col("fp")).alias("cell"), F.when(many, F.col("fp")).alias("fp"), "doc_id")

    def update(self, batch: DataFrame) -> DataFrame:
        """Index batch(doc_id, text and perhaps copy) and return doc_id, start: its windows that start in an indexed document with a smaller doc_id.

        Documents marked as copies (of a smaller doc_id, in the index or the batch) are
        stored without postings. Frequent fingerprints of old runs may have one cell
        there and several in new ones, so they are joined across cells.
        """
        if len(self.runs) >= self.fanout:
            self.compact()
        scratch = Scratch(self.spark, "substrings")
        copy = F.col("copy") if "copy" in batch.columns else F.lit(False).alias("copy")
        texts = self._write(batch.where("doc_id IS NOT NULL").select("doc_id", "text", copy), "doc_id")
        own = self._table(texts, "doc_id").where("NOT copy")
        new = self._frequent(own)
        frequent = sorted({*self.state["frequent"], *new})
        run = self._write(self._with_cells(fingerprints(own, self.window, self.gram), new), "cell")
        old = self.state["runs"]
        self._commit(runs=[*old, run], texts=[*self.state["texts"], texts], frequent=frequent)
        with sorted_buckets(self.spark):
            places = scratch.save(self._shared(run, old, frequent).groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "places")
            parts = []
            for entry in self.state["texts"]:
                known = self._table(entry, "doc_id").where("NOT copy").select("doc_id", "text")
                at = windows_at(known.join(places.hint("merge"), "doc_id"), self.window, self.gram)
                parts.append(at.withColumn("fresh", F.lit(entry["name"] == texts["name"])))
            found = scratch.save(union_all(parts), "windows")
        scratch.drop(places)
        equal = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("size")).where("a <> b").drop("b")
        # written first, so that frequent windows need not meet in one task
        later = join_groups(found, scratch.save(equal, "first"), ["w1", "w2"]).where("fresh AND doc_id > a")
        out = scratch.save(later.groupBy("doc_id").agg(F.collect_set("at").alias("start")), "repeats")
        scratch.drop(found)
        return out

    def _shared(self, run: dict, old: list[dict], frequent: list[int]) -> DataFrame:
        """fp, doc_id: postings of the new run and the old ones whose fingerprint the new one shares with another document."""
        is_frequent = F.col("fp").isin(frequent) if frequent else F.lit(False)
        rare = lambda r: self._table(r, "cell").where(~is_frequent)
        new = rare(run)
        twice = new.groupBy("cell").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
        # merge joins of bucketed, sorted tables: nothing is shuffled or sorted; the cell of a rare one is its fingerprint
        parts = [new.join(twice.select("cell").hint("merge"), "cell", "left_semi")]
        for r in old:
            parts += [new.join(rare(r).select("cell").hint("merge"), "cell", "left_semi"), rare(r).join(new.select("cell").hint("merge"), "cell", "left_semi")]
        if frequent:
            wide = union_all([self._table(r, "cell").where(is_frequent).withColumn("fresh", F.lit(r is run)) for r in [*old, run]])
            span = wide.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("fresh").alias("now"))
            # at most as many as there are frequent ones
            shared = [r["fp"] for r in span.where("a <> b AND now").select("fp").collect()]
            parts.append(wide.where(F.col("fp").isin(shared) if shared else F.lit(False)))
        return union_all([p.select("fp", "doc_id") for p in parts])

    def compact(self) -> None:
        """Merge all runs into one, and tables of texts where there are many; more rows are dealt into more buckets."""
        runs, texts = ([self._table(t, key) for t in self.state[k]] for k, key in (("runs", "cell"), ("texts", "doc_id")))
        rows = union_all(runs).count()
        self.state = {**self.state, "buckets": max(self.state["buckets"], -(-rows // BUCKET_ROWS))}
        # all runs get the cells of the newest list
        merged = self._with_cells(union_all(runs).select("fp", "doc_id"), self.state["frequent"])
        few = len(texts) <= TEXT_TABLES
        self._commit(runs=[self._write(merged, "cell")], texts=self.state["texts"] if few else [self._write(union_all(texts), "doc_id")])

    def close(self) -> None:
        """Delete the index."""
        remove(self.spark, self.folder)


def batches_of(docs: DataFrame, n: int) -> list[tuple[int | None, int | None]]:
    """n ranges of doc_id (after, up to) with about as many rows each."""
    cuts = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01) if n > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    return list(zip(edges, edges[1:], strict=False))


def drop_repeated_windows(docs: DataFrame, window: int = 13, gram: int = 5, n_batches: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text): docs without the words that earlier documents repeat.

    A new index takes the documents in batches by doc_id; the third and later ones
    meet the compacted run of those before.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    scratch = Scratch(spark, "fingerprints")
    index, found, own = FingerprintIndex(spark, f"{scratch.root}/index", window, gram), [], marked(docs, scratch)
    for low, high in batches_of(docs, n_batches):
        batch = own if low is None else own.where(F.col("doc_id") > low)
        found.append(index.update(batch if high is None else batch.where(F.col("doc_id") <= high)))
    spans = union_all(found).select("doc_id", "start", F.transform("start", lambda x: x + window).alias("stop"))
    rest = docs.where("doc_id IS NULL")
    return union_all([*(without_spans(t, spans, window) for t in index.texts()), without_spans(rest, spans.limit(0), window)])
