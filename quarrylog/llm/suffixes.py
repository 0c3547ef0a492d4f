"""Repeated passages from a sparse suffix array.

Only suffixes at minimiser positions are retained: with grams of ``gram`` words,
each window of ``window`` words holds one, at the same place in every copy. So
two copies of a passage meet at suffixes that begin with the same gram; suffixes
whose gram lies in one document only are left out before any text is read again.

The retained suffixes are sorted by the words that follow, as far as windows
reach, by a range-partitioned sort; ties go by document, so that suffixes which
agree however often are dealt to many tasks. Neighbours are compared, which gives
the common prefixes and with them the intervals of the suffix array at each
depth; intervals that run on over the border of a task are joined through the
first and last suffix of each task. For every window that selected it, a suffix
lies in the interval of the words from it on, and is extended to the left by the
words before it: windows are equal where both agree. Intervals and left sides
meet in a grouped minimum that Spark combines before the shuffle, so that groups
of any size take the same path, in time that grows with the number of windows.

Exact copies of earlier texts (by SHA-256) are set aside first. Words are
compared by their bytes, or by SHA-256 beyond 256 bytes; left sides by 128-bit
BLAKE2b digests.

A word goes if it lies in a passage of at least ``window`` words that also
starts in a document with a smaller doc_id. Null texts have no words; rows with
a null doc_id stay whole; rows that share a doc_id are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm import textcols as tc
from quarrylog.llm.minimisers import selected
from quarrylog.llm.scratch import Scratch, release
from quarrylog.llm.skew import join_groups
from quarrylog.llm.substrings import marked_texts, without_spans

#: Suffix numbers of a task begin at its partition number times this.
TASK_SPAN = 1 << 40


def retained(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, gram: the grams at which suffixes are retained, each once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()), np.int64)
            for part in tc.slices(batch.column("text")):
                begin, end, first = part.words()
                _, at, grams = selected(tc.word_hashes(part.data, begin, end), first, window, gram)
                at = np.unique(at)
                owner, keys = np.searchsorted(first, at, "right") - 1, grams[at].view(np.int64)
                order = np.lexsort((keys, owner))
                owner, keys = owner[order], keys[order]
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))[: len(owner)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[part.first + owner[new]]), pa.array(keys[new])], names=["doc_id", "gram"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, gram long")


def suffixes_at(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The retained suffixes of docs(doc_id, text, grams) whose gram is among grams.

    at is the suffix's first word; right the words from it on and left those before
    it, each with a blank behind, as far as the windows that selected it reach; low
    and high say how many words before the suffix these windows begin.
    """
    names = ["doc_id", "at", "right", "left", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()), np.int64)
            wanted = batch.column("grams")
            for part in tc.slices(batch.column("text")):
                begin, end, first = part.words()
                starts, at, grams = selected(tc.word_hashes(part.data, begin, end), first, window, gram)
                plain, byte = tc.plain_words(part.data, begin, end)
                keys, edge, rows = grams.view(np.int64), np.searchsorted(starts, first), []
                for i in range(part.n):
                    a, b = edge[i], edge[i + 1]
                    if a == b:
                        continue
                    # windows that select one suffix begin next to each other
                    places, k, n = np.unique(at[a:b], return_index=True, return_counts=True)
                    take = np.isin(keys[places], np.asarray(wanted[part.first + i].values))
                    f, doc = int(first[i]), ids[part.first + i]
                    for p, s, m in zip(places[take].tolist(), (starts[a:b][k[take]]).tolist(), n[take].tolist(), strict=True):
                        high, low = p - s, p - s - m + 1
                        rows.append((doc, p - f, plain[byte[p] : byte[p + window - low]], plain[byte[s] : byte[p]], low, high))
                    if len(rows) > 20_000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return docs.select("doc_id", "text", "grams").mapInArrow(run, "doc_id long, at int, right binary, left binary, low int, high int")


_KINDS = {"doc_id": pa.int64(), "at": pa.int32(), "right": pa.binary(), "left": pa.binary(), "low": pa.int32(), "high": pa.int32()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), names, strict=True)], names=names)


def common_words(a: bytes, b: bytes) -> int:
    """How many whole words two sequences (each word with a blank behind) have in common at their beginning."""
    if a == b:
        return a.count(b" ")
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    k = int(differ.argmax()) if differ.any() else n
    return a.count(b" ", 0, k)


def intervals(ordered: DataFrame, window: int) -> DataFrame:
    """The windows of sorted suffixes that lie in an interval with others.

    ordered has suffixes_at()'s columns, its tasks and their rows in the order of
    right. Returns doc_id, at (first word of the window), depth (words from the
    suffix on), node (number of the interval's first suffix, as far as the task
    knows), l1 and l2 (digest of the words before the suffix); and for each task two
    rows with the number (node) and right side (edge) of its first and last suffix,
    for the last also where its intervals begin (opened, by depth).
    """
    names = ["doc_id", "at", "depth", "node", "l1", "l2", "edge", "opened"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * TASK_SPAN
        opened = [number] * (window + 1)  # by depth: the first suffix of the interval the last one is in
        last, rows, held, shared = b"", [], None, window

        def windows_of(suffix, deepest, nodes):
            """Windows whose depth a neighbour shares."""
            doc, at, left, low, high = suffix
            if window - high > deepest:
                return
            stops = [0, *(i + 1 for i, c in enumerate(left) if c == 32)]
            for before in range(low, high + 1):
                depth = window - before
                if depth <= deepest:
                    digest = hashlib.blake2b(left[stops[high - before] :], digest_size=16).digest()
                    rows.append((doc, at - before, depth, nodes[depth], int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), None, None))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "at", "left", "low", "high", "right")]
            for doc, at, left, low, high, right in zip(*columns, strict=True):
                if held is None:
                    rows.append((None, None, None, number, None, None, right, None))
                else:
                    common = common_words(last, right)
                    # of the one before, both neighbours are known now
                    windows_of(held, max(shared, common), opened)
                    for depth in range(common + 1, window + 1):
                        opened[depth] = number
                    shared = common
                held, last = (doc, at, left, low, high), right
                number += 1
                if len(rows) > 50_000:
                    yield out()
        if held is not None:
            windows_of(held, window, opened)  # the next task may share any depth
            rows.append((None, None, None, number - 1, None, None, last, opened))
        if rows:
            yield out()

    return ordered.mapInArrow(run, "doc_id long, at int, depth int, node long, l1 long, l2 long, edge binary, opened array<long>")


def bordering(edges: list[tuple[int, bytes, list[int] | None]], window: int) -> list[tuple[int, int, int]]:
    """(node, depth, begin): intervals that go on over borders, by the number of their first suffix in a task, and where they begin.

    edges: two for each task, in order; number and right side of its first and of its
    last suffix, and where the last one's intervals begin within the task.
    """
    out, before, last = [], [], None
    for (number, right, _), (_, end, opened) in zip(edges[::2], edges[1::2], strict=True):
        common = 0 if last is None else common_words(last, right)
        out += [(number, depth, before[depth]) for depth in range(1, common + 1)]
        before = [before[d] if last is not None and 0 < d <= common and n == number else n for d, n in enumerate(opened)]
        last = end
    return out


def repeated_passages(texts: DataFrame, scratch: Scratch, window: int = 50, gram: int = 10) -> DataFrame:
    """doc_id, at: the windows (by their first word) of texts that also start in an earlier document."""
    spark = texts.sparkSession
    sampled = scratch.save(retained(texts, window, gram), "retained")
    shared = scratch.save(sampled.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("size")).where("a <> b").select("gram", "size"), "grams")
    places = scratch.save(join_groups(sampled, shared, ["gram"]).groupBy("doc_id").agg(F.collect_set("gram").alias("grams")), "places")
    scratch.drop(sampled, shared)
    found = scratch.save(suffixes_at(texts.join(places.hint("merge"), "doc_id"), window, gram), "suffixes")
    scratch.drop(places)
    order = ["right", "doc_id", "at"]
    ordered = found.repartitionByRange(*order).sortWithinPartitions(*order)
    windows = scratch.save(intervals(ordered, window), "windows")
    scratch.drop(found)
    # two rows for each task of the sort, of at most ``window`` words each
    rows = windows.where("edge IS NOT NULL").select("node", "edge", "opened").collect()
    edges = sorted(((r["node"], bytes(r["edge"]), r["opened"]) for r in rows), key=lambda e: (e[0], e[2] is not None))
    joined = spark.createDataFrame(bordering(edges, window), "node long, depth int, begin long")
    named = windows.where("edge IS NULL").drop("edge").join(F.broadcast(joined), ["node", "depth"], "left")
    named = named.select("doc_id", "at", F.coalesce("begin", "node").alias("node"), "depth", "l1", "l2")
    by = ["node", "depth", "l1", "l2"]
    equal = named.groupBy(*by).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("size")).where("a <> b").drop("b")
    return join_groups(named, scratch.save(equal, "equal"), by).where("doc_id > a").select("doc_id", "at")


def drop_repeated_passages(docs: DataFrame, window: int = 50, gram: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text): docs without the passages that earlier documents hold."""
    scratch = Scratch(docs.sparkSession, "passages")
    texts = marked_texts(docs, scratch)
    found = repeated_passages(texts.where("NOT copy"), scratch, window, gram)
    spans = found.groupBy("doc_id").agg(F.collect_set("at").alias("start"))
    spans = scratch.save(spans.select("doc_id", "start", F.transform("start", lambda x: x + window).alias("stop")), "spans")
    release(docs.sparkSession)
    rest = docs.select("doc_id", "text").where("doc_id IS NULL")
    return without_spans(texts, spans, window).unionByName(without_spans(rest, spans.limit(0), window))
