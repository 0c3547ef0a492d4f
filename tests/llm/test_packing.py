import zlib
from collections import defaultdict

import numpy as np

from quarrylog.llm import packing

from .conftest import corpus, make


def check(rows, pieces, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, text in rows:
        ids = np.append(packing.byte_encoder("byte_bpe_50k.tiktoken", "<|endoftext|>", 50256).encode_to_numpy(text or "", allowed_special="all"), 1).astype("<u4")
        own = sorted(by_doc[doc], key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids) and bytes(p.ids) == ids[at : at + p.length].tobytes()
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_pieces(spark):
    rows = corpus() + [(900, "word " * 9000)]
    for window in (64, 2048):
        for docs in (make(spark, rows), make(spark, rows).coalesce(1)):
            check(rows, packing.pack(docs, window=window).collect(), window)


def test_bounded_open_windows(spark):
    rows = corpus(3)
    check(rows, packing.pack(make(spark, rows), window=256, max_open_tokens=300).collect(), 256)


def test_special_token_and_checksum(spark):
    [row] = packing.pack(make(spark, [(5, "<|endoftext|>")])).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [50256, 1] and zlib.crc32(row.ids) > 0


def test_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(2)
    p = packing.LevelPacker(16, 0, 10**9)
    for size in rng.integers(1, 16, 300):
        costs = {}
        for h in range(0, 17 - size):
            if h and not p.level[h]:
                continue
            after = p.level.copy()
            after[h] -= 1 if h else 0
            after[h + size] += 1
            costs[h] = int((after[1:16] ** 2).sum())
        assert costs[p.choose(int(size))] == min(costs.values())
        p.add((0, 0, 0, np.zeros(size, "<u4")))


def test_ids_are_those_of_the_tokenizers_library(spark):
    """Independent of the operator's own encoder and of the ranks file it reads."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus(4) + [(900, "\u4f60\u597d \U0001f600\u200d\U0001f469 \u0915\u094d\u0937 e\u0301 \u00a0\u2003x"), (901, "a\r\n\r\n  b\t\tc   "), (902, "don't WE'LL 12345678 ...!!!"), (903, "<|endoftext|> x"), (904, "\x00\x01 \ufffd")]
    pieces = defaultdict(list)
    for p in packing.pack(make(spark, rows)).collect():
        pieces[p.doc_id].append((p.start, bytes(p.ids)))
    for doc, text in rows:
        got = np.frombuffer(b"".join(i for _, i in sorted(pieces[doc])), "<u4").tolist()
        assert got == [*library.encode(text or "", add_special_tokens=False).ids, 1], doc


def test_what_the_rule_placed_stays():
    """Closing cuts few documents of the open windows; the others stay together as the level rule placed them."""
    rng = np.random.default_rng(5)
    p = packing.LevelPacker(2048, 0, 10**9)
    for doc, size in enumerate(rng.integers(20, 1500, 2000).tolist()):
        p.add((doc, 0, size, np.zeros(size, "<u4")))
    kept = sum(sum(len(x[3]) for x in w) for ws in p.open.values() for w in ws)
    done = p.close(True)
    same = sum(sum(len(x[3]) for x in w if x[1] == 0 and len(x[3]) == x[2]) for _, w in done)
    assert sum(len(x[3]) for _, w in done for x in w) == kept
    assert same >= 0.85 * kept


def test_awkward_rows(spark, awkward):
    got = packing.pack(awkward)
    tokens = got.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in tokens} == {None, 1, 2, 7}
    assert packing.pack(make(spark, [])).count() == 0
