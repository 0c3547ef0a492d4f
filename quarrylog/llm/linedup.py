"""Repeated line runs, from a suffix array over line-id sequences built by distributed prefix doubling.

A document is the sequence of its lines that hold a word; a line's id is the rank
of its SHA-256 digest (128 bits of it) among the lines that repeat. Doubling
(Manber and Myers, 1990) then ranks the runs of 2, 4, 8, ... lines that begin at
each position: the rank of 2 m lines at p follows from the ranks of m lines at p
and p + m, by one range-partitioned sort of the distinct pairs. Equal ranks are
an interval of the suffix array with a common prefix of m lines, and ranks are
in the order of the line ids. Positions whose interval has shrunk to one are
settled and drop out, as no longer run through them repeats; doubling goes on
until none is left, which is at the longest repeat.

Each interval knows its first position, in the order of doc_id and position. A
position other than the first is where a later copy begins, as long as its
deepest interval; overlapping copies join to the maximal repeated runs, and runs
of at least ``min_lines`` lines go.

With ``line_words``, a single line of that many words is a run too, whatever its
neighbours; so is one of five times as many characters, as not every script puts
blanks between words.

Lines without a word are not part of the sequence and stay. Null texts count as
empty. Rows with a null doc_id stay whole. Equal rows are one document; rows
that share a doc_id but not the text are ordered by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.columns import bind, free_prefix
from quarrylog.llm.scratch import Scratch
from quarrylog.llm.skew import join_groups, union_all

KEY = ["doc_id", "v"]
WORD = "[^ \\t\\n\\x0B\\f\\r]"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def line_ids(docs: DataFrame, line_words: int | None = None) -> DataFrame:
    """doc_id, v (hash of the text), j (number among the lines with a word), line (digest), long (see is_long)."""
    filled = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("v"), F.posexplode(filled).alias("j", "line"))
    long = F.lit(False) if line_words is None else is_long(F.col("line"), line_words)
    return rows.select(*KEY, "j", F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("line"), long.alias("long"))


def is_long(line: Column, line_words: int) -> Column:
    """Has the line so many words, or five times as many characters that are not blanks?"""
    words = F.size(F.filter(F.split(line, BLANKS), lambda w: w != ""))
    return (F.length(F.translate(line, " \t\n\x0b\f\r", "")) >= 5 * line_words) | (words >= line_words)


def ranked(named: DataFrame, by: list[str], scratch: Scratch, depth: int) -> DataFrame | None:
    """named(doc_id, v, j, by...) of intervals with more than one position; rank and first (position) in place of by. None if there is none.

    The rank is the place of the interval in a global sort by ``by``, in steps of its own.
    """
    place = F.struct(*KEY, "j")
    groups = named.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("size")).where("first <> last").drop("last")
    ordered = groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    intervals = scratch.save(ordered, f"intervals{depth}")
    total = intervals.agg(F.sum("size")).first()[0]
    if not total:
        return None
    found = join_groups(named, intervals, by, total=total).drop(*by)
    # equal rows of docs give equal positions, which are one
    return scratch.save(found.dropDuplicates([*KEY, "j"]) if depth == 1 else found, f"ranks{depth}")


def depths(min_lines: int):
    """1, 2, 4, ...; min_lines comes in its place."""
    depth = 1
    while True:
        yield depth
        depth = min_lines if depth < min_lines < 2 * depth else 2 * depth


def suffix_intervals(lines: DataFrame, min_lines: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """For each depth up to the longest repeat: the positions in intervals of that depth, with rank and first; lines from line_ids()."""
    out: list[tuple[int, DataFrame]] = []
    for depth in depths(min_lines):
        if not out:
            named, by = lines, ["line"]
        else:
            before, at = out[-1]
            after = at.select(*KEY, (F.col("j") - (depth - before)).alias("j"), F.col("rank").alias("next"))
            named, by = at.select(*KEY, "j", "rank").join(after.hint("merge"), [*KEY, "j"]).withColumnRenamed("rank", "begin"), ["begin", "next"]
            named = scratch.save(named, f"pairs{depth}")
        now = ranked(named, by, scratch, depth)
        if out:
            scratch.drop(named)
        if now is None:
            return out
        out.append((depth, now))


def later_copies(docs: DataFrame, min_lines: int, scratch: Scratch, line_words: int | None = None) -> DataFrame:
    """doc_id, v, runs: the maximal runs (begin, stop; numbers among lines with a word) of each document's lines to delete."""
    lines = scratch.save(line_ids(docs, line_words), "lines")
    found = suffix_intervals(lines, min_lines, scratch)
    scratch.drop(lines)
    later = F.col("first") < F.struct(*KEY, "j")
    at = lambda table, depth: table.where(later).select(*KEY, "j", F.lit(depth).alias("n"))
    parts = [at(t.where("long") if d < min_lines else t, d) for d, t in found if d == 1 or d >= min_lines]
    if not parts:
        none = docs.sparkSession.createDataFrame([], "n int").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("j"), "n")
        parts = [none]
    deepest = union_all(parts).groupBy(*KEY, "j").agg(F.max("n").alias("n"))
    # a copy that begins behind the end of all before it begins a maximal run
    before = Window.partitionBy(*KEY).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("j")
    stop = F.col("j") + F.col("n")
    opened = deepest.withColumn("new", F.coalesce(F.max(stop).over(before) < F.col("j"), F.lit(True)).cast("int"))
    runs = opened.withColumn("run", F.sum("new").over(upto)).groupBy(*KEY, "run").agg(F.min("j").alias("begin"), F.max(stop).alias("stop"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = 2, prefix: str = "", line_words: int | None = None) -> DataFrame:
    """docs with its column text rewritten, and columns n_lines (with a word) and n_removed, named with ``prefix``."""
    scratch = Scratch(docs.sparkSession, "linedup")
    gone = scratch.save(later_copies(docs.select("doc_id", "text"), min_lines, scratch, line_words), "gone")
    own = free_prefix(docs.columns)
    runs = F.col(f"{own}runs")
    key = (F.col("doc_id") == F.col(f"{own}d")) & (F.xxhash64("text") == F.col(f"{own}v"))
    # texts are always dealt out by key: whether the other side is small must not depend on the input
    marked = docs.join(gone.toDF(f"{own}d", f"{own}v", f"{own}runs").hint("merge"), key, "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    numbers = F.flatten(F.transform(runs, lambda r: F.sequence(r["begin"], r["stop"] - 1)))

    def without(found):
        """The lines whose numbers are not among those to delete."""
        left = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), F.transform(numbers, lambda j: F.get(s["filled"], j)))
        return bind(F.struct(found.alias("lines"), F.filter(F.transform(found, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull()).alias("filled")), lambda s: F.array_join(F.transform(left(s), lambda i: F.get(s["lines"], i)), "\n"))

    text = F.when(runs.isNull(), F.col("text")).otherwise(bind(lines, without))
    removed = F.aggregate(runs, F.lit(0), lambda n, r: n + r["stop"] - r["begin"])
    return marked.select(
        *(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.size(F.filter(lines, lambda x: x.rlike(WORD))).cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias(f"{prefix}n_removed"),
    )
