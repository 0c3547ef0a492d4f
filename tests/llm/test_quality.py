import random
import re
from collections import Counter

import numpy as np

from quarrylog.llm import quality
from quarrylog.llm.scratch import Scratch

from .conftest import corpus, make


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts(spark):
    rows = corpus() + [(300, "a b c a b c\na b c\na b c"), (301, "#x# <y> 100% & | *$"), (302, "é😀 ß"), (303, "u v"), (304, "p q r s " * 30)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(make(spark, rows)).collect()}
    assert got == {d: brute(t) for d, t in rows}


def prose(rng, n, symbols=0.0):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 7))) + ("###" if rng.random() < symbols else "") for _ in range(n))


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(60, 400)), "en", f"s{i % 2}", 0) for i in range(240)]
    rows += [(1000 + i, prose(rng, 150, 0.9), "en", "s0", 0) for i in range(20)]
    rows += [(2000 + i, prose(rng, 150, 0.9), "xx", "tiny", 0) for i in range(3)]  # too few for a verdict
    got = {r.doc_id: r.kept for r in quality.quality(make(spark, rows)).collect()}
    assert all(got[i] for i in range(240)) and not any(got[1000 + i] for i in range(20)) and all(got[2000 + i] for i in range(3))


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(60, 400)), "en", "s", 0) for i in range(240)]
    block = prose(rng, 34)
    planted = {
        "length": prose(rng, 9000),
        "word": " ".join("abcdefghijklmnop"[rng.randrange(3) :] + rng.choice("qrst") * 2 + rng.choice("abcdefgh") for _ in range(150)),
        "symbols": prose(rng, 85) + " " + " ".join(w + "#" for w in prose(rng, 15).split()),
        "lines": "\n".join(f"{prose(rng, 30)}\nsame" for _ in range(5)),
        "repeats": f"{prose(rng, 40)} {block} {prose(rng, 42)} {block}",
    }
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(planted.values())]
    got = {r.doc_id: r for r in quality.quality(make(spark, rows)).collect()}
    assert sum(got[i].kept for i in range(240)) >= 238
    assert {k: (got[1000 + i].base_failed, got[1000 + i].kept) for i, k in enumerate(planted)} == dict.fromkeys(planted, (False, False))


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5)) + 2 * np.eye(5)
    x = rng.normal(size=(4000, 5)) @ mix
    df = spark.createDataFrame([("p", False, *map(float, r)) for r in x], "pool string, base_failed boolean, " + ", ".join(f"{c} double" for c in quality.STATISTICS))
    got = [r for r in quality.robust_distances(df, Scratch(spark, "t"), accuracy=10000).collect()]
    y = np.array([[r[c] for c in quality.STATISTICS] for r in got])
    inverse = np.linalg.inv(mix.T @ mix)
    want = np.einsum("ij,jk,ik->i", y, inverse, y)
    assert np.corrcoef(want, [r.distance for r in got])[0, 1] > 0.98


def test_a_correlated_cluster_of_outliers(spark):
    """A fifth of the rows lies off the line of the rest, no statistic of its own extreme; the smallest determinant leaves them out."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1600, 5)) * 0.3
    base[:, 1] = base[:, 0] * 3 + rng.normal(size=1600) * 0.02
    base[:, 0] *= 3
    off = rng.normal(size=(300, 5)) * 0.1
    off[:, 0] += 1.5
    off[:, 1] -= 1.5
    x = np.vstack([base, off])
    df = spark.createDataFrame([("p", False, *map(float, r)) for r in x], "pool string, base_failed boolean, " + ", ".join(f"{c} double" for c in quality.STATISTICS))
    got = quality.robust_distances(df.withColumn("n", quality.F.monotonically_increasing_id()), Scratch(spark, "t"), accuracy=10000).orderBy("n").collect()
    distance = np.array([r.distance for r in got])
    assert (distance[1600:] > quality.CUTOFF).mean() > 0.95 and (distance[:1600] > quality.CUTOFF).mean() < 0.03


def test_awkward_rows(spark, awkward):
    got = quality.quality(awkward).collect()
    assert len(got) == awkward.count() and not any(r.kept for r in got if r.doc_id == 2)
    assert quality.quality(make(spark, [])).count() == 0
    nulls = make(spark, [(i, prose(random.Random(i), 80), None, None if i % 2 else "s", 0) for i in range(80)])
    assert all(r.kept for r in quality.quality(nulls).collect())


def test_pools_joined_by_broadcast_or_shuffle_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = make(spark, [(i, prose(rng, rng.randint(60, 200), 0.9 if i % 40 == 0 else 0.0), ["en", "de", None][i % 3], "s", 0) for i in range(240)])
    verdicts = []
    for parts in (512, 1):  # every pool is large; none is
        monkeypatch.setattr(quality, "PARTS", parts)
        verdicts.append({r.doc_id: (r.kept, round(r.distance, 6)) for r in quality.quality(rows).collect()})
    assert verdicts[0] == verdicts[1] and len(verdicts[0]) == 240
