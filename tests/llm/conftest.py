import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text) or full rows; spread over several partitions."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3) if full else spark.createDataFrame([], schema)


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages and lines, empty and null ones."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "été", "straße", "the", "of", "and", "42"]
    sentence = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(k))
    passage, line = sentence(70), sentence(12)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "one two"), (5, "a\x0bb\x0cc d")]
    for i in range(6, n):
        kind = rng.random()
        if kind < 0.15 and i > 12:
            text = rows[rng.randrange(6, i)][1]
        elif kind < 0.3 and i > 12:
            w = rows[rng.randrange(6, i)][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind < 0.5:
            text = sentence(rng.randint(1, 40)) + "\n" + passage + "\n" + sentence(rng.randint(1, 40))
        else:
            text = "\n".join(sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3:
            text = f"{line}\n{line}\n{text}"
        rows.append((i, text))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, corpus())


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, repeated rows, and further columns with names that operators use themselves."""
    rows = [(None, "x y z " * 30), (1, "x y z " * 30), (1, "x y z " * 30), (2, None), (2, None), (7, "long " * 20000), (None, None)]
    df = make(spark, rows)
    for name in ("kept", "score", "start", "copy", "bits", "n_lines", "fp", "gram", "ids", "part", "node", "h"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df
