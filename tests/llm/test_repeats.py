"""Repeated lines, windows and passages, against plain Python."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from quarrylog.llm import linedup, minimisers, substrings, suffixes
from quarrylog.llm.scratch import Scratch

from .conftest import corpus, make


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_windows(rows, size):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def brute_lines(rows, size):
    first, out = {}, {}
    seqs = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if words(x)] for d, t in rows}
    for d in sorted(seqs):
        for j in range(len(seqs[d]) - size + 1):
            first.setdefault(tuple(x for _, x in seqs[d][j : j + size]), (d, j))
    for d, t in rows:
        gone = set()
        for j in range(len(seqs[d]) - size + 1):
            if first[tuple(x for _, x in seqs[d][j : j + size])] < (d, j):
                gone |= {i for i, _ in seqs[d][j : j + size]}
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out[d] = (kept, len(seqs[d]), len(gone))
    return out


def test_windows(spark, docs):
    want = brute_windows(corpus(), 13)
    for batches in (1, 3):
        got = {r[0]: tuple(r[1:]) for r in substrings.drop_repeated_windows(docs, 13, n_batches=batches).collect()}
        assert got == want


def test_passages(spark, docs):
    for size in (50, 20):
        got = {r[0]: tuple(r[1:]) for r in suffixes.drop_repeated_passages(docs, size, 8).collect()}
        assert got == brute_windows(corpus(), size)


def test_one_passage_in_many_documents(spark):
    """A hot group: its suffixes are sorted in several tasks, and intervals go on over their borders."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i}") for i in range(40)]
    rows += [(i, f"a{i} {passage[: 3 * i]} other words {passage} {passage}") for i in range(40, 60)]
    got = {r[0]: tuple(r[1:]) for r in suffixes.drop_repeated_passages(make(spark, rows), 50, 10).collect()}
    assert got == brute_windows(rows, 50)


def test_intervals_over_borders(spark):
    """Intervals of the sorted suffixes are those of one task, wherever its rows are cut into tasks."""
    right = sorted([b"a b c ", b"a b c ", b"a b d ", b"a b d ", b"a e f ", b"b ", b"b b b ", b"b b b ", b"b b b ", b"c d e "])

    def windows(parts):
        rows = [(i, 0, r, b"", 0, 0) for i, r in enumerate(right)]
        schema = "doc_id long, at int, right binary, left binary, low int, high int"
        table = spark.createDataFrame(rows, schema)
        cut = table.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
        found = suffixes.intervals(cut, 3).collect()
        edges = sorted(((r.node, bytes(r.edge), r.opened) for r in found if r.edge is not None), key=lambda e: (e[0], e[2] is not None))
        begin = {(n, d): b for n, d, b in suffixes.bordering(edges, 3)}
        node = {r.doc_id: begin.get((r.node, r.depth), r.node) for r in found if r.edge is None}
        groups = {}
        for d, n in node.items():
            groups.setdefault(n, set()).add(d)
        return sorted(sorted(g) for g in groups.values() if len(g) > 1), len(edges)

    want = [[0, 1], [2, 3], [6, 7, 8]]
    for parts in (1, 2, 3, 5, 10):
        assert windows(parts)[0] == want


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_with_cancelling_sums(spark):
    """Long words whose polynomial hashes modulo 2**64 agree are different words."""
    x, y = thue_morse(2048), thue_morse(2048, True)
    head = " ".join(f"h{i}" for i in range(12))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {x}")]
    got = {r.doc_id: r.n_removed for r in substrings.drop_repeated_windows(make(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    head = " ".join(f"h{i}" for i in range(49))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {x}")]
    got = {r.doc_id: r.n_removed for r in suffixes.drop_repeated_passages(make(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_very_long_words(spark):
    big = "z" * 300_000
    rows = [(i, " ".join([f"s{i}"] + [f"w{k}" for k in range(30)] + [big + "1"] + [f"v{k}" for k in range(30)])) for i in range(3)]
    rows.append((9, rows[0][1].replace(big + "1", big + "2")))
    for found, size in ((substrings.drop_repeated_windows(make(spark, rows), 13), 13), (suffixes.drop_repeated_passages(make(spark, rows), 50), 50)):
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute_windows(rows, size)


def test_one_id_with_different_texts(spark):
    """They are one document: what one of them repeats from the other stays, what others repeat from either goes."""
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(5, p), (5, q), (5, f"{p} x"), (7, f"{p} y"), (8, f"{q} z"), (3, "short")]
    for found in (substrings.drop_repeated_windows(make(spark, rows)), suffixes.drop_repeated_passages(make(spark, rows))):
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found.collect()) == [(3, 1, 0), (5, 60, 0), (5, 60, 0), (5, 61, 0), (7, 61, 60), (8, 61, 60)]


def test_lines(spark):
    block = "first line here\nsecond line\n\nthird one"
    rows = corpus(5) + [(200, block), (201, f"x y\n{block}\nz"), (202, f"{block}\n{block}"), (203, "a b\na b\na b\na b"), (204, "lone\n\n\n")]
    for size in (1, 2, 3, 5):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linedup.drop_repeated_lines(make(spark, rows), size).collect()}
        assert got == brute_lines(rows, size)


def test_long_single_lines(spark):
    """A long line whose neighbours differ everywhere; short lines and the first copy stay."""
    long, cjk, short = " ".join(f"w{i}" for i in range(60)), "\u6f22" * 45, "a heading"
    rows = [(i, f"top {i}\n{long}\nmid {i}\n{cjk}\nnext {i}\n{short}\nend {i}") for i in range(9)]
    rows += [(20, f"{long}\nonly here\n{long}"), (21, long)]
    got = {r.doc_id: (r.text, r.n_removed) for r in linedup.drop_repeated_lines(make(spark, rows), 2, line_words=8).collect()}
    assert got[0] == (rows[0][1], 0)
    assert all(got[i] == (f"top {i}\nmid {i}\nnext {i}\n{short}\nend {i}", 2) for i in range(1, 9))
    assert got[20] == ("only here", 2) and got[21] == ("", 1)
    import corpus_pipeline

    staged = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, make(spark, rows), "").collect()}
    assert staged == {d: t for d, (t, _) in got.items() if d != 21}


def test_awkward_rows(spark, awkward):
    lines = linedup.drop_repeated_lines(awkward, 2, prefix="__")
    assert lines.count() == awkward.count() and lines.columns[: len(awkward.columns)] == awkward.columns
    empty = make(spark, [])
    for found in (substrings.drop_repeated_windows(awkward), suffixes.drop_repeated_passages(awkward)):
        got = found.collect()
        assert len(got) == awkward.count()
        assert sorted(r.n_words for r in got) == [0, 0, 0, 90, 90, 90, 20000]
        assert all(r.n_removed == 0 for r in got)  # one document's repetitions, equal ids and null ids take nothing
    assert linedup.drop_repeated_lines(empty).count() == 0
    assert substrings.drop_repeated_windows(empty).count() == 0
    assert suffixes.drop_repeated_passages(empty).count() == 0


def test_ranks_and_intervals(spark):
    """Ranks order the runs at each depth as their line ids do; intervals are the positions of equal runs; doubling ends at the longest repeat."""
    seqs = {1: "a b a b a b c", 2: "a b a b x", 3: "c a b a", 4: "q"}
    docs = make(spark, [(d, "\n".join(t.split())) for d, t in seqs.items()])
    lines = linedup.line_ids(docs).cache()
    ids = {(r.doc_id, r.j): bytes(r.line) for r in lines.collect()}
    found = linedup.suffix_intervals(lines, 2, Scratch(spark, "t"))
    assert [d for d, _ in found] == [1, 2, 4]
    for depth, table in found:
        runs = {}
        for d, t in seqs.items():
            for j in range(len(t.split()) - depth + 1):
                runs.setdefault(tuple(ids[d, j + i] for i in range(depth)), []).append((d, j))
        runs = {k: v for k, v in runs.items() if len(v) > 1}
        got = table.collect()
        by_rank = {}
        for r in got:
            by_rank.setdefault(r.rank, []).append((r.doc_id, r.j))
            assert (r.first.doc_id, r.first.j) == min(v for v in runs.values() if (r.doc_id, r.j) in v)[0]
        assert [sorted(by_rank[r]) for r in sorted(by_rank)] == [sorted(runs[k]) for k in sorted(runs)]


def test_maximal_runs(spark):
    block = [f"line {i}" for i in range(100)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["new", *block[10:73], "mid", *block[5:7], "end"]))]
    gone = linedup.later_copies(make(spark, rows).select("doc_id", "text"), 2, Scratch(spark, "t")).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs]) for r in gone] == [(2, [(1, 64), (65, 67)])]


def test_index_goes_on_in_a_new_session(spark, monkeypatch):
    """Batches after reopening meet the runs of those before; a compacted run is what later batches read."""
    rows = [(1000 * k + d, t) for k, seed in enumerate((1, 2, 1, 3, 2)) for d, t in corpus(seed, 40) if d > 5]
    want = brute_windows(rows, 5)
    monkeypatch.setattr(substrings, "TEXT_TABLES", 2)
    folder = Scratch(spark, "t").root + "/index"
    found, sizes = {}, []
    for k in range(5):
        index = substrings.FingerprintIndex(spark, folder, window=5, gram=3, buckets=4, fanout=2)
        batch = make(spark, [r for r in rows if r[0] // 1000 == k])
        found |= {r.doc_id: r.start for r in index.update(batch).collect()}
        sizes.append(len(index.runs))
    assert sizes == [1, 2, 2, 2, 2]
    for d, (n, gone, _) in want.items():
        cover = {i + k for i in found.get(d, []) for k in range(5)}
        assert len(cover) == gone, d
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]
    assert sum(t.count() for t in index.texts()) == len(rows)
    index.close()


def test_runs_meet_as_they_are_stored(spark):
    """No shuffle; nothing is sorted but the fingerprints that a run shares within itself."""
    setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(setting)
    index = substrings.FingerprintIndex(spark, Scratch(spark, "t").root + "/index", window=5, gram=3, buckets=4)
    rows = corpus(3, 20)
    for part in (rows[:10], rows[10:]):
        index.update(make(spark, part))
    assert spark.conf.get(setting) == before
    old, run = index.state["runs"]
    with substrings.sorted_buckets(spark):
        plan = index._shared(run, [old], [])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Sort [") == 1
    index.close()


def test_runs_store_a_fingerprint_once_and_in_order(spark):
    """fp is stored only where the cell is another; the writer finds the rows sorted by cell."""
    index = substrings.FingerprintIndex(spark, Scratch(spark, "t").root + "/index", window=5, gram=3, buckets=4)
    setting = "spark.sql.optimizer.plannedWrite.enabled"
    before = spark.conf.get(setting)
    index.update(make(spark, corpus(3, 20)))
    assert spark.conf.get(setting) == before
    (run,) = index.state["runs"]
    stored = spark.read.parquet(f"{index.folder}/{run['name']}")
    assert stored.count() > 0 and stored.where("fp IS NOT NULL").count() == 0
    assert index._table(run, "cell").where("fp = cell").count() == stored.count()
    for part in stored.select("cell").rdd.glom().collect():
        assert part == sorted(part)
    spread = index._with_cells(stored.select(F.col("cell").alias("fp"), "doc_id"), [stored.first().cell])
    assert spread.where("fp IS NOT NULL").select("fp").distinct().count() == 1
    index.close()


def test_windows_at_wanted_fingerprints(spark):
    """Against each document's windows looked at alone; also where a document before wants what the next one has."""
    import hashlib
    import random

    import numpy as np

    rng = random.Random(5)
    texts = ["", "a b", *(" ".join(rng.choice(["x", "yy", "é", "z" * 300, "w"]) + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 60))) for _ in range(30))]
    rows, want, last = [], set(), []
    for d, text in enumerate(texts):
        words = text.encode().split()
        (part,) = list(substrings.tc.slices(pa.array([text])))
        begin, end, first = part.words()
        starts, at, grams = minimisers.selected(substrings.tc.word_hashes(part.data, begin, end), first, 5, 3)
        prints = grams[at].view(np.int64).tolist()
        fps = sorted(set(prints[::7]))
        rows.append((d, text, fps + [x for x in last if x not in prints]))
        last = prints[:3]
        for i, fp in zip(starts.tolist(), prints, strict=True):
            if fp in fps:
                plain = b"".join((w if len(w) <= 256 else w[:64] + b"\xff" + hashlib.sha256(w).hexdigest().encode()) + b" " for w in words[i : i + 5])
                want.add((d, i, *np.frombuffer(hashlib.blake2b(plain, digest_size=16).digest(), np.int64).tolist()))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fps array<long>").coalesce(1)
    got = [tuple(r) for r in substrings.windows_at(docs, 5, 3).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_frequent_fingerprints_take_many_buckets(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i}") for i in range(200)]
    folder = Scratch(spark, "t").root + "/index"
    index = substrings.FingerprintIndex(spark, folder, buckets=4)
    index._frequent = lambda batch: [r.fp for r in substrings.fingerprints(batch, 13, 5).groupBy("fp").count().where("count > 50").collect()]
    first = index.update(make(spark, rows[:100])).count()
    again = index.update(make(spark, rows[100:])).collect()
    assert first == 99 and index.state["frequent"]
    assert index._table(index.state["runs"][1], "cell").where(F.col("fp").isin(index.state["frequent"])).select("cell").distinct().count() > 20
    assert len(again) == 100 and all(sorted(r.start) == list(range(3, 11)) for r in again)


def test_minimisers_agree_between_copies():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    for width in (1, 2, 7, 41):
        got = minimisers.sliding_argmin(base, width)
        want = [i + int(np.argmin(base[i : i + width] >> np.uint64(24))) for i in range(len(base) - width + 1)]
        assert got.tolist() == want
