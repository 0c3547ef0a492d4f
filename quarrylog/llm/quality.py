"""Quality rules and robust multivariate outliers, in DataFrame operations alone.

Base rules judge a document by its own counts. Those that pass are compared with
their group: for each language and source, a minimum covariance determinant
estimate gives a centre and a scatter matrix that outliers cannot pull away, and a
document whose transformed statistics lie too far from the centre, by
Mahalanobis distance, is rejected.

The estimate is made as in the deterministic algorithm (Rousseeuw and Van Driessen, 1999;
Hubert, Rousseeuw and Verdonck, "A deterministic algorithm for robust location
and scatter", 2012), with three of its kinds of starts: from each, concentration steps take mean and covariance over
the ``share`` of a group's rows that are nearest so far, until the determinant
settles, and the start with the smallest determinant counts. Quantiles are
approximate (percentile_approx), so subsets may differ from exact ones by a
2000th of a group. Every step is a grouped aggregate that Spark combines before
the shuffle. The scatter is scaled for consistency, and each statistic's variance
gets a floor, so that statistics which are zero nearly everywhere do no harm.

Sources with fewer than ``least_rows`` usable rows are pooled by language, and
what is still too small is pooled altogether; a pool that stays too small gives
no verdict, so its rows are kept. Rows meet the estimates of pools with more than a
512th of all rows, of which there are fewer than 512, by a broadcast join, so that a
large pool never lies in one task; smaller ones are shuffled. Null language or
source is a value of its own.
Null texts count as empty and fail the base rules. Null ids and repeated rows
are carried through; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.columns import bind
from quarrylog.llm.scratch import Scratch
from quarrylog.llm.skew import PARTS, join_groups

BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: Added to each transformed statistic's deviation (as squares), so small that each can pass the cutoff alone: in a pool
#: without any, at about 0.09 symbols a word, 3 duplicate lines or a fifth of the words repeated.
FLOORS = {"x_length": 0.3, "x_word": 0.05, "x_symbols": 0.02, "x_lines": 0.25, "x_repeats": 0.1}
#: Quantile 0.999 of chi-square with five degrees of freedom.
CUTOFF = 20.515
STATISTICS = list(FLOORS)
#: Fixed values for five statistics: share / P(chi2_7 <= quantile of chi2_5 at share), for share 0.75.
CONSISTENCY = 1.412


def counts(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each docs(doc_id, text, lang, source)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("t"))
    words = F.filter(F.split("t", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    squeezed = F.length(F.translate("t", BLANKS, ""))
    return base.select(
        "doc_id", "lang", "source",
        squeezed.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
    ).select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more: equal windows meet when sorted."""

    def of_sorted(s: Column) -> Column:
        hit = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
        near = F.flatten(F.transform(F.filter(hit, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))
        return F.size(F.array_distinct(near)).cast("long")

    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(bind(F.array_sort(F.transform(starts, window)), of_sorted))


def judged(counted: DataFrame, least_words: int = 50, most_repeated_percent: int = 50) -> DataFrame:
    """counted with base_failed and the transformed statistics."""
    n = F.greatest("n_words", F.lit(1))
    return counted.withColumns({
        "base_failed": (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words")),
        "x_length": F.log1p("n_words"),
        "x_word": F.log1p(F.col("word_chars") / n),
        "x_symbols": F.asinh(F.col("n_symbols") / n),
        "x_lines": F.log1p("n_dup_lines"),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


def pools(rows: DataFrame, least_rows: int, scratch: Scratch) -> DataFrame:
    """rows with a column pool: language and source, or what they are pooled to (null: no verdict)."""
    tag = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("null"))
    rows = rows.withColumns({"l": tag("lang"), "ls": F.concat(tag("lang"), F.lit("/"), tag("source"))})
    by_source = scratch.save(rows.groupBy("l", "ls").agg(F.count("*").alias("size"), F.count_if(~F.col("base_failed")).alias("count")), "sources")
    own = F.col("count") >= least_rows
    by_lang = by_source.where(~own).groupBy("l").agg(F.sum("count").alias("count"))
    rest = by_lang.where(~own).select(F.sum("count")).scalar()
    pooled = by_source.join(by_lang.select("l", F.col("count").alias("n_l")), "l", "left")
    pool = F.when(own, F.col("ls")).when(F.col("n_l") >= least_rows, F.col("l")).when(rest >= least_rows, F.lit("*"))
    chosen = scratch.save(pooled.select("ls", "size", pool.alias("pool")), "pool")
    return join_groups(rows, chosen, ["ls"]).drop("l", "ls")


def _marked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with hot: the pool holds a large part of all rows, or there is none, so that no estimate is to be met."""
    sizes = scratch.save(rows.groupBy("pool").count(), "sizes")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    large = sizes.where(F.col("count") * PARTS > total).select("pool", F.lit(True).alias("hot"))
    return rows.join(F.broadcast(large), "pool", "left").withColumn("hot", F.coalesce("hot", F.col("pool").isNull()))


def _meet(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of pools; both have hot, which the pool decides."""
    near = rows.where("hot").join(F.broadcast(table.where("hot").drop("hot")), "pool", how)
    return near.unionByName(rows.where("NOT hot").join(table.where("NOT hot").drop("hot").hint("merge"), "pool", how))


def _distance(centre: dict[str, Column], lower: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    solved: list[Column] = []
    for i, x in enumerate(STATISTICS):
        left = reduce(lambda acc, j: acc - lower[i, j] * solved[j], range(i), F.col(x) - centre[x])
        solved.append(left / lower[i, i])
    return reduce(lambda a, b: a + b, (y * y for y in solved))


def _factor(table: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor l_i_j of the scatter v_i_j, one column at a time."""
    p = len(STATISTICS)
    for j in range(p):
        inner = reduce(lambda acc, k, j=j: acc - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"v_{j}_{j}"))
        table = table.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(inner, F.lit(1e-12))))
        table = table.withColumns({
            f"l_{i}_{j}": reduce(lambda acc, k, i=i, j=j: acc - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"v_{j}_{i}")) / F.col(f"l_{j}_{j}")
            for i in range(j + 1, p)
        })
    return table


def _with_distance(rows: DataFrame, model: DataFrame, *more: str) -> DataFrame:
    p = len(STATISTICS)
    lower = {(i, j): F.col(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)}
    joined = _meet(rows, model, "left")
    return joined.withColumn("distance", _distance({x: F.col(f"c_{x}") for x in STATISTICS}, lower)).select(*rows.columns, *more, "distance")


def starts(usable: DataFrame, scratch: Scratch, accuracy: int) -> DataFrame:
    """pool, hot, start, c_x, l_i_j: centres (medians) and factored scatters from which concentration sets out.

    diagonal: median absolute deviations alone. tanh: covariance of the hyperbolic
    tangents of the scaled statistics. pairwise: correlations from the median absolute
    deviations of each two statistics' sums and differences (Gnanadesikan and
    Kettenring), which a minority off the line of the rest does not change.
    """
    p = len(STATISTICS)
    median = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(accuracy))
    centre = scratch.save(usable.groupBy("pool", "hot").agg(*(median(x).alias(f"c_{x}") for x in STATISTICS)), "medians")
    spread = _meet(usable, centre).groupBy("pool").agg(*(median(F.abs(F.col(x) - F.col(f"c_{x}"))).alias(f"d_{i}") for i, x in enumerate(STATISTICS)))
    scale = [F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(FLOORS[x])).alias(f"s_{i}") for i, x in enumerate(STATISTICS)]
    scaled = scratch.save(centre.join(spread, "pool").select("pool", "hot", *(f"c_{x}" for x in STATISTICS), *scale), "scales")
    z = [(F.col(x) - F.col(f"c_{x}")) / F.col(f"s_{i}") for i, x in enumerate(STATISTICS)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    shaped = _meet(usable, scaled).select("pool", *(c.alias(f"z_{i}") for i, c in enumerate(z)), *(F.tanh(c).alias(f"t_{i}") for i, c in enumerate(z)))
    apart = [median(F.abs(F.col(f"z_{i}") + s * F.col(f"z_{j}"))).alias(f"{n}_{i}_{j}") for i, j in pairs if i < j for n, s in (("a", 1), ("b", -1))]
    known = scaled.join(shaped.groupBy("pool").agg(*(F.covar_pop(f"t_{i}", f"t_{j}").alias(f"t_{i}_{j}") for i, j in pairs), *apart), "pool")

    def pairwise(i: int, j: int) -> Column:
        a, b = F.col(f"a_{i}_{j}") * F.col(f"a_{i}_{j}"), F.col(f"b_{i}_{j}") * F.col(f"b_{i}_{j}")
        return 0.98 * (a - b) / F.greatest(a + b, F.lit(1e-12))

    one_of = {"diagonal": lambda i, j: F.lit(0.0), "tanh": lambda i, j: F.col(f"t_{i}_{j}"), "pairwise": pairwise}
    each = [
        known.select("pool", "hot", F.lit(name).alias("start"), *(f"c_{x}" for x in STATISTICS), *(
            ((F.lit(1.0) if i == j and name != "tanh" else of(i, j)) * F.col(f"s_{i}") * F.col(f"s_{j}") + (FLOORS[STATISTICS[i]] ** 2 if i == j else 0)).alias(f"v_{i}_{j}") for i, j in pairs
        )) for name, of in one_of.items()
    ]
    return _factor(reduce(DataFrame.unionByName, each))


def robust_distances(rows: DataFrame, scratch: Scratch, share: float = 0.75, steps: int = 8, accuracy: int = 2000, tolerance: float = 0.01) -> DataFrame:
    """rows(pool, base_failed, x_...) with distance: squared and robust, null without a pool.

    Concentration goes on until no pool's log determinant changes by more than
    ``tolerance`` from any start, or for ``steps`` steps; of a pool's starts the one
    with the smallest determinant counts.
    """
    columns, rows = rows.columns, _marked(rows, scratch)
    p, usable = len(STATISTICS), rows.where("NOT base_failed AND pool IS NOT NULL").select("pool", "hot", *STATISTICS)
    size = 2 * reduce(lambda a, b: a + b, (F.log(F.col(f"l_{i}_{i}")) for i in range(p)))
    model = scratch.save(starts(usable, scratch, accuracy).withColumn("size", size), "start")
    for step in range(steps):
        far = _with_distance(usable, model, "start")
        edge = far.groupBy("pool", "start").agg(F.percentile_approx("distance", F.lit(share), F.lit(accuracy)).alias("edge"))
        bounded = scratch.save(model.join(edge, ["pool", "start"]), f"edge{step}")
        near = _with_distance(usable, bounded, "start", "edge").where("distance <= edge")
        moments = near.groupBy("pool", "hot", "start").agg(*(F.avg(x).alias(f"c_{x}") for x in STATISTICS), *(F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"v_{i}_{j}") for i in range(p) for j in range(i, p)))
        scaled = moments.withColumns({f"v_{i}_{j}": CONSISTENCY * F.col(f"v_{i}_{j}") + (FLOORS[STATISTICS[i]] ** 2 if i == j else 0) for i in range(p) for j in range(i, p)})
        after = scratch.save(_factor(scaled).withColumn("size", size), f"step{step}")
        moved = after.select("pool", "start", "size").join(model.select("pool", "start", F.col("size").alias("before")), ["pool", "start"])
        model = after
        if step and (moved.agg(F.max(F.abs(F.col("size") - F.col("before")))).first()[0] or 0.0) <= tolerance:
            break
    values = [c for c in model.columns if c not in ("pool", "hot", "size")]
    best = model.groupBy("pool", "hot").agg(F.min(F.struct("size", *values)).alias("m")).select("pool", "hot", *(F.col(f"m.{c}").alias(c) for c in values))
    return _with_distance(rows, best).select(*columns, "distance")


def quality(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = 60, **base) -> DataFrame:
    """Counts, base_failed, distance and kept of docs(doc_id, text, lang, source).

    The default cutoff is passed by one of a thousand rows of a normal
    distribution in five statistics.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(judged(counts(docs), **base), "counts")
    far = robust_distances(scratch.save(pools(rows, least_rows, scratch), "pools"), scratch)
    inlier = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & inlier).alias("kept"))
