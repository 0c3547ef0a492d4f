"""MinHash near-duplicates with Odd sketches.

Each document becomes a set of word shingles. MinHash samples of the set serve
twice: in bands they are the keys of candidate buckets, and folded into a parity
bitmap (an Odd sketch: each sample flips one bit) they estimate a pair's
similarity from the population count of the bitmaps' XOR. Pairs that the
sketches rule out go; the rest is confirmed on the full sets. (Mitzenmacher,
Pagh and Pham, "Efficient estimation for high similarities using Odd sketches",
2014.)

Documents with equal sets form a class, and one document stands for it. A bucket
is not expanded into all its pairs. In each round some of its members, its
centres, are compared with all the others that are not in their component, and
then leave; the bucket is done when what is left lies in one component, as no
further link can change the result. So a bucket of n copies takes n comparisons, and no pair that could join
two components is left out.

Buckets that are still mixed after the first round hold texts that share a
frequent passage but little else. Their documents are grouped anew by an exact
rule: two sets of the wanted similarity share one of the few shingles that come
first in each when shingles are sorted by frequency, rare ones first (prefix
filtering; Chaudhuri, Ganti and Kaushik, 2006). How many shingles follow a first
common one bounds the overlap, which rules out most of the remaining pairs before
they are formed.

Rows without words are linked with nothing. A null doc_id can be no component's
id: such rows are linked with nothing, and component_id is null. Rows that
share a doc_id count as the same document, whatever their texts: what any of them
is linked with belongs to one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm import textcols as tc
from quarrylog.llm.components import connected_components
from quarrylog.llm.scratch import Scratch
from quarrylog.llm.skew import join_groups

U = np.uint64
SKETCH_BITS = 256
SKETCH_COLUMNS = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def shingle_sets(part: tc.Slice, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and the same shingles' hashes of a second family; fewer words than ``size`` make one shingle."""
    data = tc.lower_ascii(part.data)
    starts, ends, first = part.words()
    words = [tc.word_hashes(data, starts, ends, family) for family in (0, 1)]
    grams, sets, others = [tc.gram_hashes(w, size) for w in words], [], []
    for i, n in enumerate(np.diff(first)):
        if n >= size:
            own, at = np.unique(grams[0][first[i] : first[i + 1] - size + 1], return_index=True)
            sets.append(own)
            others.append(grams[1][first[i] + at])
        else:
            for out, w in ((sets, words[0]), (others, words[1])):
                out.append(tc.gram_hashes(w[first[i] : first[i + 1]], n, seed=int(n)) if n else np.zeros(0, U))
    return sets, others


def set_keys(values: np.ndarray, others: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, from the hashes of either family, independent of order."""
    with np.errstate(over="ignore"):
        a = np.add.reduceat(tc.mix(values ^ U(0x2545F4914F6CDD1D)), starts)
        b = np.add.reduceat(tc.mix(others * U(0x9FB21C651E98DF25)), starts)
    return tc.mix(a), tc.mix(b)


def min_hashes(values: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples [sample, set] under permutations x -> a * x + b of 32-bit numbers."""
    rng = np.random.default_rng(20140407)
    a = rng.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, samples, dtype=np.uint32)
    x = (values >> U(32)).astype(np.uint32)
    out = np.empty((samples, len(starts)), np.uint32)
    for i in range(samples):
        out[i] = np.minimum.reduceat(x * a[i] + b[i], starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps [set, 64-bit word] of MinHash samples [sample, set]."""
    k, n = samples.shape
    keyed = tc.mix(samples.astype(U) ^ (np.arange(k, dtype=U)[:, None] << U(32)))
    bits = (keyed & U(SKETCH_BITS - 1)).astype(np.int64) + np.arange(n) * SKETCH_BITS
    odd = np.bincount(bits.ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def sketch_limit(samples: int, similarity: float) -> int:
    """The XOR population count expected at a similarity."""
    flips = 2 * samples * (1 - similarity)
    return round(SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** flips) / 2)


def features(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set keys, band keys and Odd sketch of each document."""
    names = ["doc_id", "n_shingles", "k1", "k2", "bands", *SKETCH_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for part in tc.slices(batch.column("text")):
                sets, others = shingle_sets(part, shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = sizes > 0
                keys = np.zeros((2 + len(SKETCH_COLUMNS), part.n), np.int64)
                banded = np.zeros((0, bands), np.int64)
                if full.any():
                    values = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[full]
                    k1, k2 = set_keys(values, np.concatenate(others), starts)
                    samples = min_hashes(values, starts, bands * rows)
                    keys[0, full], keys[1, full] = k1.view(np.int64), k2.view(np.int64)
                    keys[2:, full] = odd_sketches(samples).T
                    wide = samples.astype(U).reshape(bands, rows, -1)
                    key = np.broadcast_to(np.arange(bands, dtype=U)[:, None], wide[:, 0].shape)
                    for r in range(rows):
                        key = tc.mix(key ^ wide[:, r] + U((0x632BE59BD9B4E019 * (r + 1)) & 0xFFFFFFFFFFFFFFFF))
                    banded = key.T.copy().view(np.int64)
                ends = np.concatenate([[0], np.cumsum(full)]) * bands
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(banded.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, part.n), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]), lists, *map(pa.array, keys[2:])], names=names)

    kinds = ", ".join(f"{c} {'array<long>' if c == 'bands' else 'long'}" for c in names)
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """k1, k2, shingles: the whole sets of docs and their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.slices(batch.column("text")):
                sets, others = shingle_sets(part, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                values, seconds = (np.concatenate([x[i] for i in full]) for x in (sets, others))
                ends = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])])
                k1, k2 = set_keys(values, seconds, ends[:-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists], names=["k1", "k2", "shingles"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, shingles array<long>")


def rare_groups(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """bucket, node, m, f: nodes of sets(node, shingles) by the shingles one of which they share with any partner.

    Shingles are ordered by frequency f, then by value. m: how many of the node's
    shingles come from this one on; two sets whose first common shingle this is have
    no larger overlap (the positional filter of Xiao et al., 2008).
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    counts = scratch.save(each.groupBy("shingle").agg(F.count("*").alias("f")).withColumn("size", F.col("f")), "counts")
    ranked = join_groups(each, counts, ["shingle"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("r"))
    size = F.size("r")
    wanted = F.ceil(size * percent / F.lit(100.0)).cast("int")
    first = ranked.select("node", size.alias("n"), F.posexplode(F.slice("r", F.lit(1), size - wanted + 1)).alias("i", "s"))
    return first.where("s.f > 1").select(F.col("s.shingle").alias("bucket"), "node", (F.col("n") - F.col("i")).alias("m"), F.col("s.f").alias("f"))


def one_of_each(members: DataFrame, scratch: Scratch) -> DataFrame:
    """members(bucket, node, f) without buckets of one node, and without those that hold the same nodes as one that comes before them in order of f."""
    groups = members.groupBy("bucket").agg(F.min("f").alias("f"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    chosen = groups.where("n > 1").groupBy("n", "s", "x").agg(F.min(F.struct("f", "bucket")).alias("b")).select("b.bucket")
    return members.join(scratch.save(chosen, "chosen").hint("merge"), "bucket", "left_semi")


def mixed_only(members: DataFrame, scratch: Scratch) -> DataFrame:
    """members(bucket, part, ...) of buckets with more than one part."""
    mixed = members.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("bucket")
    return members.join(scratch.save(mixed, "mixed").hint("merge"), "bucket", "left_semi")


def xor_count() -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH_COLUMNS))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, bands: int = 24, rows: int = 4, slack: float = 0.27) -> DataFrame:
    """Components of docs(doc_id, text) under links of at least ``percent`` % Jaccard similarity.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and kept
    (doc_id = component_id). Links that share none of the bands are missed: at
    0.85 about 2 of 100 million, with the default of 24 bands of 4. Sketches
    discard pairs estimated at ``slack`` below the threshold, over seven standard
    deviations.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    limit = sketch_limit(bands * rows, percent / 100 - slack)
    found = scratch.save(features(docs, shingle, bands, rows), "features")
    usable = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "bands", *SKETCH_COLUMNS)).alias("r")
    size = F.min("n_shingles").alias("n")
    grouped = usable.groupBy("k1", "k2").agg(least, size, F.count("*").alias("copies"))
    # a class has a number of its own: its smallest doc_id may be that of another class too
    classes = scratch.save(grouped.select("k1", "k2", F.monotonically_increasing_id().alias("node"), F.col("r.doc_id").alias("doc"), "copies", "n", F.col("r.bands").alias("bands"), *(F.col(f"r.{c}") for c in SKETCH_COLUMNS)), "classes")
    rows_of = classes.select("node", "copies", "n", F.explode("bands").alias("bucket"))
    members = scratch.save(one_of_each(rows_of.withColumn("f", F.lit(0)), scratch).drop("f"), "members")
    nodes = members.select("node").distinct()
    compared = scratch.save(classes.select("k1", "k2", "node", "doc", *SKETCH_COLUMNS).join(nodes.hint("merge"), "node", "left_semi"), "sketches")
    sketches = compared.select("node", *SKETCH_COLUMNS)
    texts = docs.select("doc_id", "text").join(compared.select(F.col("doc").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = full_sets(texts, shingle).dropDuplicates(["k1", "k2"]).join(compared.select("k1", "k2", "node").hint("merge"), ["k1", "k2"])
    sets = scratch.save(sets.select("node", "shingles"), "sets")
    side = lambda t, x: t.select(*(F.col(c).alias(f"{x}_{c}" if c != "node" else x) for c in t.columns))
    links, tested, round_, parts = None, None, 0, None
    members = members.withColumns({"part": F.col("node"), "m": F.col("n")})
    while not members.isEmpty():
        # centres: first what has most copies, then members of a bucket's smaller components, ever more at a time
        slot = F.pmod(F.xxhash64("node"), F.lit(64**round_))
        sizes = members.groupBy("bucket", "part").agg(F.count("*").alias("size"))
        first = F.struct((-F.col("copies")).alias("o"), "node") if not round_ else F.struct(F.col("size").alias("o"), "node")
        ranked = members if not round_ else members.join(scratch.save(sizes, "sizes").hint("merge"), ["bucket", "part"])
        centres = ranked.groupBy("bucket", slot.alias("slot")).agg(F.min(first).alias("m")).select("bucket", F.col("m.node").alias("node"))
        centres = scratch.save(members.join(centres.hint("merge"), ["bucket", "node"]).select("bucket", F.col("node").alias("centre"), F.col("part").alias("centre_part"), F.col("n").alias("centre_n"), F.col("m").alias("centre_m")), "centres")
        pairs = members.join(centres.hint("merge"), "bucket").where(f"part <> centre_part AND {100 + percent} * least(m, centre_m) >= {percent} * (n + centre_n)").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        likely = pairs.join(side(sketches, "a").hint("merge"), "a").join(side(sketches, "b").hint("merge"), "b").where(xor_count() <= limit).select("a", "b")
        both = likely.join(side(sets, "a").hint("merge"), "a").join(side(sets, "b").hint("merge"), "b")
        common = F.size(F.array_intersect("a_shingles", "b_shingles"))
        sized = both.select("a", "b", common.alias("i"), (F.size("a_shingles") + F.size("b_shingles")).alias("n"))
        new = scratch.save(sized.where(f"100L * i >= {percent}L * (n - i)").select("a", "b"), "links")
        links = new if links is None else links.union(new)
        tested = pairs if tested is None else tested.union(pairs)
        parts = connected_components(links, scratch)
        rest = members.drop("part").join(centres.select("bucket", F.col("centre").alias("node")).hint("merge"), ["bucket", "node"], "left_anti")
        if not round_:
            named = rest.join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
            unsettled = scratch.save(mixed_only(named, scratch).select("node", "copies", "n").distinct(), "unsettled")
            rare = scratch.save(rare_groups(sets.join(unsettled.hint("merge"), "node", "left_semi"), percent, scratch), "rare")
            rest = one_of_each(rare, scratch).drop("f").join(unsettled.hint("merge"), "node")
        named = rest.join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        after = scratch.save(mixed_only(named, scratch), "members")
        scratch.drop(members, centres)
        members, round_ = after, round_ + 1
    scratch.drop(sets, compared, members)
    own = usable.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "node").hint("merge"), ["k1", "k2"]).select("doc_id", "node").distinct()
    # rows that share a doc_id but not the text are one document, which links their classes
    ids = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    twins = scratch.save(own.join(ids.hint("merge"), "doc_id").where("a <> node").select("a", F.col("node").alias("b")), "twins")
    if not twins.isEmpty():
        links = twins if links is None else links.union(twins)
        parts = connected_components(links, scratch)
    named = classes.select("k1", "k2", "node", "doc", "copies")
    part = F.col("node") if parts is None else F.coalesce("component", "node")
    named = named if parts is None else named.join(parts.hint("merge"), "node", "left")
    named = scratch.save(named.select("k1", "k2", "doc", "copies", part.alias("part")), "parts")
    least = scratch.save(named.groupBy("part").agg(F.min("doc").alias("component"), F.count("*").alias("size")), "least")
    named = scratch.save(join_groups(named, least, ["part"]).select("k1", "k2", "component", F.col("copies").alias("size")), "named")
    known = join_groups(usable.select("doc_id", "n_shingles", "k1", "k2"), named, ["k1", "k2"]).select("doc_id", "n_shingles", "component")
    rest = found.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return known.union(rest).select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))
