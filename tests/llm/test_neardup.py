import re

from quarrylog.llm import components, neardup
from quarrylog.llm.scratch import Scratch

from .conftest import corpus, make


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def test_against_brute_force(spark, docs):
    for percent in (80, 85):
        got = {r[0]: tuple(r[1:]) for r in neardup.near_duplicates(docs, percent=percent).collect()}
        assert got == brute(corpus(), percent)


def test_many_copies_and_a_frequent_passage(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base if i % 3 else base.replace("w5 ", f"x{i} ")) for i in range(60)]
    rows += [(100 + i, "common words shared by many small documents here " * 2 + f"own{i} text{i} more{i} of{i} it{i}") for i in range(40)]
    got = {r[0]: tuple(r[1:]) for r in neardup.near_duplicates(make(spark, rows)).collect()}
    assert got == brute(rows, 85)


def test_awkward_rows(spark, awkward):
    got = neardup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r.component_id == r.doc_id and r.kept for r in got)
    assert neardup.near_duplicates(make(spark, [])).count() == 0


def test_one_id_with_different_texts(spark):
    """Links of any of its texts are links of the document."""
    p, q = (" ".join(f"{c}{i}" for i in range(80)) for c in "pq")
    rows = [(5, p), (5, q), (7, p + " end"), (8, q + " end"), (9, "something else altogether here now")]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(make(spark, rows)).collect()}
    assert got == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)}


def test_words_with_cancelling_sums(spark):
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, x), (2, x.translate(str.maketrans("ab", "ba"))), (3, x), (4, "z" * 300_000), (5, "z" * 300_001)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(make(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for share in (0.5, 0.85, 0.95):
        other = base.copy()
        n = round(4000 * (1 - share) / (1 + share))
        other[:n] = rng.integers(0, 1 << 63, n)
        values = np.concatenate([np.sort(base), np.sort(other)])
        sketch = neardup.odd_sketches(neardup.min_hashes(values, np.array([0, 4000]), 512))
        apart = sum(bin(int(a) & (2**64 - 1) ^ int(b) & (2**64 - 1)).count("1") for a, b in zip(*sketch, strict=True))
        assert abs(apart - neardup.sketch_limit(512, share)) <= 28


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 45: 40, 50: 40}
