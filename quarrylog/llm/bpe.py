"""Backtracking byte-pair encoding, and decoding through an offset table.

A word's encoding is the only token sequence in which each neighbouring pair is
compatible: merging the two tokens' characters together by rank would leave the
border between them alone. An Aho-Corasick automaton gives all tokens that
match at each position. The encoder takes the longest match at the current
position that is compatible with the token before it; where none is, it marks
the position as a dead end and goes back. Since a prefix has only one valid
encoding, no position is expanded twice, so a word takes linear time.

Whether a pair is compatible follows from the merges along the left token's
right edge and the right token's left edge; answers are kept in a table.

A null text counts as empty. Repeated rows and null ids are carried through,
long texts are handled whole, and other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylog.llm.vocab import vocabulary_path

END = "\0"
#: Words kept with their encodings in each Python worker.
CACHE_WORDS = 400_000
_NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(own)))
    return [table[b] for b in range(256)]


class WordEncoder:
    """Encodes words of one vocabulary of merges with an end-of-word mark."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab, n = model["vocab"], len(self.suffix)
        plain = lambda token: token[:-n] + END if n and token.endswith(self.suffix) else token
        self.id_of = {plain(t): i for t, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = plain(a), plain(b)
            pair, whole = (self.id_of[a], self.id_of[b]), self.id_of[a + b]
            self.rank[pair] = rank
            self.parts.setdefault(whole, (*pair, rank))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            if token not in self.added:
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.letters = byte_characters()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        #: Characters on which all Unicode versions agree; texts with others are split by the tokenizer's own parts.
        self.unusual = regex.compile("[^\\x00-ԯ -⁠]")
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = _Words(self)
        # offset table of token strings, each followed by a blank
        names = {i: t.encode() for t, i in (vocab | self.added).items()}
        table = [names.get(i, b"") + b" " for i in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost symbol at the border (side 1: right end) up to the token: (symbol, rank at which it is merged inwards)."""
        known = self.edges[side].get(token)
        if known is None:
            known, at, rank = [(token, _NEVER)], token, _NEVER
            while at in self.parts:
                left, right, rank = self.parts[at]
                at = right if side else left
                known.append((at, rank))
            known.reverse()
            self.edges[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Would no merge cross the border of a and b before both are complete?"""
        known = self.pairs.get((a, b))
        if known is None:
            left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
            while True:
                (x, absorbed_x), (y, absorbed_y) = left[i], right[j]
                cross = self.rank.get((x, y), _NEVER)
                if cross < absorbed_x and cross <= absorbed_y:
                    known = False
                elif absorbed_x == absorbed_y == _NEVER:
                    known = True
                elif absorbed_x <= absorbed_y:  # of equal pairs the left one is merged first
                    i += 1
                    continue
                else:
                    j += 1
                    continue
                break
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def stands(self, token: int) -> bool:
        """Is the token the encoding of its own characters?"""
        known = self.own.get(token)
        if known is None:
            known = token not in self.parts
            if not known:
                left, right, rank = self.parts[token]
                known = self.stands(left) and self.stands(right) and self._meets(left, right, rank)
            self.own[token] = known
        return known

    def _meets(self, a: int, b: int, rank: int) -> bool:
        """Do a and b both come about before a merge by ``rank`` joins them?"""
        left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            (x, absorbed_x), (y, absorbed_y) = left[i], right[j]
            if absorbed_x == absorbed_y == _NEVER:
                return self.rank.get((x, y)) == rank
            cross = self.rank.get((x, y), _NEVER)
            if cross < absorbed_x and cross <= absorbed_y:
                return False
            if absorbed_x <= absorbed_y:
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        """Token ids of a word (its bytes as byte characters, the end mark last)."""
        n = len(word)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for last, (token, size) in self.automaton.iter(word):
            at[last + 1 - size].append((last + 1, token))
        taken: list[int] = []
        place, tried, dead = [0], [len(at[0]) - 1], set()
        while True:
            pos, i = place[-1], tried[-1]
            options, before = at[pos], taken[-1] if taken else None
            while i >= 0:
                end, token = options[i]
                if end not in dead and self.stands(token) and (before is None or self.compatible(before, token)):
                    break
                i -= 1
            if i < 0:
                if not taken:
                    raise ValueError(f"no encoding for {word!r}")
                dead.add(pos)
                place.pop()
                tried.pop()
                taken.pop()
                tried[-1] -= 1
                continue
            tried[-1] = i
            taken.append(token)
            if end == n:
                return taken
            place.append(end)
            tried.append(len(at[end]) - 1)

    def words(self, text: str) -> list[str]:
        """The text's words: composed, in lower case, cut by the vocabulary's pattern."""
        if self.unusual.search(text):
            normal = self.tokenizer.normalizer.normalize_str(text)
            back = {c: b for b, c in enumerate(self.letters)}
            return [bytes(back[c] for c in w).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.split.findall(text.replace("Σ", "σ").lower())

    def encode(self, text: str) -> np.ndarray:
        if self.special is None or not self.special.search(text):
            return self._encode(text)
        out, done = [], 0
        for m in self.special.finditer(text):
            out += [self._encode(text[done : m.start()]), np.array([self.added[m[0]]], np.int32)]
            done = m.end()
        return np.concatenate([*out, self._encode(text[done:])])

    def _encode(self, text: str) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return np.fromiter(chain.from_iterable(map(self.cache.__getitem__, self.words(text))), np.int32)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts of id sequences (first: where each begins, then the total): their bytes, joined, and offsets.

        Token strings are separated by one blank, as no decoder is set.
        """
        begin = self.offset[ids]
        size = self.offset[ids + 1] - begin
        size[(first[1:] - 1)[np.diff(first) > 0]] -= 1  # no blank at the end
        to = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(to[-1]) - np.repeat(to[:-1] - begin, size)
        return self.bytes[source].tobytes(), to[first]


class _Words(dict):
    """Encodings of words, made on first use."""

    def __init__(self, owner: WordEncoder):
        self.owner = owner

    def __missing__(self, word: str) -> tuple[int, ...]:
        letters = self.owner.letters
        ids = tuple(self.owner.encode_word("".join([letters[b] for b in word.encode()]) + END))
        if len(word) <= 40:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, vocab: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids array<int> of each docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary_path(vocab))
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                parts = [encoder.encode(t.as_py() or "") for t in batch.column("text")]
                first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(parts), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab: str = "word_bpe_49k.json") -> DataFrame:
    """encoded(doc_id, ids) with a column decoded: the text of the ids (null ids: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary_path(vocab))
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                lists = batch.column("ids")
                sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                ids = np.asarray(lists.flatten(), np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                data, offsets = encoder.decode(ids, first)
                text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                if lists.null_count:
                    text = pa.compute.if_else(lists.is_valid(), text, None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, text], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
