import random

import numpy as np

from quarrylog.llm import langid

from .conftest import make

WORDS = {"aa": ["kala", "muro", "tili", "sana"], "bb": ["strud", "grenk", "plofs", "dwirt"], "cc": ["éàü", "ñôé", "çêà", "ûîé"]}


def rows(n=200, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    return out


def test_held_out_accuracy_and_contract(spark):
    docs = make(spark, rows() + [(900, None, "aa", "s", 0), (901, "12 .. 3", None, "s", 0), (902, "", "bb", "s", 0)])
    samples = langid.sample_texts(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(docs, samples).collect()}
    truth = {r[0]: r[2] for r in rows()}
    assert np.mean([got[i].lang_pred == truth[i] for i in truth]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_phrases_against_search():
    model = langid.Model({"x": "the cat sat on the mat and the dog", "y": "der hund und die katze"})
    rng = random.Random(2)
    texts = ["".join(rng.choice("thecatsonmdgruz  é1") for _ in range(rng.randint(0, 700))) for _ in range(40)]
    symbols, first = model.alphabet.classes(texts)
    got = model.phrases(symbols, first)
    for i in range(len(texts)):
        own = symbols[first[i] : first[i + 1]]
        for k, lang in enumerate(model.langs):
            sample = model.alphabet.classes([{"x": "the cat sat on the mat and the dog", "y": "der hund und die katze"}[lang]])[0].tobytes()
            count = 0
            for at in range(0, len(own), langid.SEGMENT):
                text, p = own[at : at + langid.SEGMENT].tobytes(), 0
                while p < len(text):
                    q = p + 1
                    while q <= len(text) and text[p:q] in sample:
                        q += 1
                    p, count = max(p + 1, q - 1), count + 1
            assert got[i, k] == count


def test_awkward_rows(spark, awkward):
    got = langid.predict(awkward, langid.sample_texts(awkward), carry=awkward.columns, prefix="__")
    assert got.count() == awkward.count() and got.columns[: len(awkward.columns)] == awkward.columns
    empty = make(spark, [])
    assert langid.sample_texts(empty) == {} and langid.predict(empty, {}).count() == 0
    assert langid.predict(make(spark, [(1, "abc")]), {}).first().lang_pred == "und"


def test_carried_text_goes_to_python_once(spark):
    docs = make(spark, [*rows(30), (901, "12 .. 3", None, "s", 0), (902, None, "bb", "s", 0)])
    samples = langid.sample_texts(docs)
    found = langid.predict(docs, samples, carry=docs.columns, prefix="__")
    # what the Python function is given
    assert found._jdf.queryExecution().analyzed().children().head().output().size() == len(docs.columns)
    plain = {r.doc_id: (r.lang_pred, r.score, r.bits) for r in langid.predict(docs, samples).collect()}
    assert {r.doc_id: tuple(r[f"__{c}"] for c in ("lang_pred", "score", "bits")) for r in found.collect()} == plain
    assert sorted(r.text or "" for r in found.collect()) == sorted(r.text or "" for r in docs.collect())


def han(rng, first, n):
    """Words of two of 300 letters, each of the second letters with a few first ones."""
    return " ".join("".join(chr(first + rng.randrange(300)) for _ in range(2)) for _ in range(n))


def test_languages_of_one_large_script():
    """Two languages of Chinese letters beside Latin and Cyrillic ones; a third script is unknown."""
    rng = random.Random(4)
    latin = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz\u00e4\u00f6\u00fc") for _ in range(5)) for _ in range(2000))
    cyrillic = " ".join("".join(chr(0x430 + rng.randrange(32)) for _ in range(5)) for _ in range(2000))
    model = langid.Model({"la": latin, "ru": cyrillic, "h1": han(rng, 0x4E00, 6000), "h2": han(rng, 0x4E00 + 150, 6000)})
    texts = [han(rng, 0x4E00, 40) for _ in range(30)] + [han(rng, 0x4E00 + 150, 40) for _ in range(30)]
    bits = model.entropies([*texts, han(rng, 0xAC00, 40)])
    assert [model.langs[i] for i in bits.argmin(axis=1)[:-1]] == ["h1"] * 30 + ["h2"] * 30
    limits = np.array([max(8.0, 1.25 * model.own(k)) for k in model.langs])
    assert (bits[:-1].min(axis=1) <= limits[bits[:-1].argmin(axis=1)]).all() and (bits[-1] > limits).all()


def test_hashed_transitions_are_those_of_the_table(monkeypatch):
    rng = random.Random(5)
    samples = {"x": "".join(rng.choice("abcd ") for _ in range(3000)), "y": han(rng, 0x4E00, 700)}
    texts = ["".join(rng.choice("abcde ") for _ in range(600)), han(rng, 0x4E00, 300), "", "zz"]
    dense = langid.Model(samples)
    monkeypatch.setattr(langid, "DENSE", 0)
    sparse = langid.Model(samples)
    assert [a.dense for a in dense.automata + sparse.automata] == [True, True, False, False]
    assert (dense.phrases(*dense.alphabet.classes(texts)) == sparse.phrases(*sparse.alphabet.classes(texts))).all()


def test_every_labelled_language_is_learned(spark):
    """Eighty languages of ten letters each, the last ones with a single row."""
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(800)]
    text = lambda k, n: " ".join("".join(rng.choice(letters[10 * k : 10 * k + 10]) for _ in range(4)) for _ in range(n))
    out = [(100 * k + i, text(k, 30), f"l{k:02}", "s", 0) for k in range(80) for i in range(3 if k < 60 else 1)]
    samples = langid.sample_texts(make(spark, out), sample_docs=2, sample_chars=1000)
    assert sorted(samples) == [f"l{k:02}" for k in range(80)] and max(map(len, samples.values())) <= 800
    model = langid.Model(samples)
    assert [model.langs[i] for i in model.entropies([text(k, 20) for k in range(80)]).argmin(axis=1)] == [f"l{k:02}" for k in range(80)]
