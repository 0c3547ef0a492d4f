import random

from tokenizers import Tokenizer

from quarrylog.llm import bpe
from quarrylog.llm.vocab import vocabulary_path

from .conftest import corpus, make

PATH = vocabulary_path("word_bpe_49k.json")


def test_against_the_library(spark):
    library, rng = Tokenizer.from_file(PATH), random.Random(4)
    parts = ["a", "aa", "th", "the", "in", " ", "'s", "1", "é", "ß", "你", "😀", "̈", "!", "...", "A", "Σ", "İ", "<|endoftext|>", "\x85", "\xa0", "\n", "ing", "Ω", "0"]
    rows = corpus() + [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(5000, "ab" * 4000)]
    got = bpe.decode(bpe.encode(make(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_pair_table_agrees_with_plain_merging():
    e, rng = bpe.word_encoder(PATH), random.Random(7)
    text_of = {i: t for t, i in e.id_of.items() if t not in e.added}

    def merge(symbols):
        while True:
            ranks = [(e.rank.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
            if not ranks or min(ranks)[0] == 1 << 60:
                return symbols
            k = min(ranks)[1]
            whole = e.id_of[text_of[symbols[k]] + text_of[symbols[k + 1]]]
            symbols = [*symbols[:k], whole, *symbols[k + 2 :]]

    def base(token):
        return base(e.parts[token][0]) + base(e.parts[token][1]) if token in e.parts else [token]

    short = [i for i, t in text_of.items() if len(t) < 6 and not t.endswith(bpe.END)]
    for _ in range(2000):
        a, b = rng.choice(short), rng.choice(short)
        if e.stands(a) and e.stands(b):
            assert e.compatible(a, b) == (merge(base(a) + base(b)) == [a, b])


def test_awkward_rows(spark, awkward):
    got = bpe.decode(bpe.encode(awkward)).collect()
    assert len(got) == awkward.count()
    assert [list(r.ids) for r in got if r.doc_id == 2] == [[], []] and all(r.decoded == "" for r in got if r.doc_id == 2)
    assert bpe.encode(make(spark, [])).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded is None
