"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of labelled text. A
document is parsed from left to right into the longest phrases that occur in the
language's sample; few phrases mean that the text is like the sample. With c
phrases over n characters and a sample of m characters, c * log2(m) / n
estimates the cross entropy in bits a character; the language with the lowest
value wins. (Ziv and Merhav, "A measure of relative entropy between individual
sequences with application to universal classification", 1993.)

Characters are letters in lower case; everything between them counts as one
blank. Every letter of the samples is a symbol of its own, in any script; a
letter that a language's sample lacks is a phrase of its own there. A text is parsed in segments of fixed length, all of them side by side,
which adds at most one phrase a segment and is the same for every language.

Every labelled language is learned. Samples are bounded: ``sample_docs``
documents a language, the first ``sample_doc_chars`` characters of each,
``sample_chars`` characters in all; where there are more than 64 languages, all
of them get smaller shares of the same total. Automata are built from the
samples in each Python worker; each has only the letters of its own sample.

A null text, or one without a letter, gives ``und`` with score 0. Without any
labelled text every prediction is ``und``. Repeated rows give repeated rows,
null ids are carried through, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.textcols import SLICE_BYTES

SEGMENT = 256
BLANK, OTHER = 0, 1
UNDETERMINED = "und"


def sample_texts(labelled: DataFrame, sample_docs: int = 64, sample_doc_chars: int = 4000, sample_chars: int = 40_000, full_languages: int = 64) -> dict[str, str]:
    """A bounded sample of each language of labelled(text, lang), chosen by a hash of the text.

    Beyond ``full_languages`` languages each gets a smaller share of the same total.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.substring("text", 1, sample_doc_chars).alias("text")).where(F.col("text").rlike("\\p{L}"))
    share = min(1.0, full_languages / max(1, rows.select("lang").distinct().count()))
    slots, chars = max(1, int(sample_docs * share)), max(256, int(sample_chars * share))
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min(F.struct("h", "text")).alias("m"))
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["m"]["h"], r["m"]["text"])):
        out.setdefault(r["lang"], []).append(r["m"]["text"])
    return {lang: "\n".join(texts)[:chars] for lang, texts in out.items() if any(c.isalpha() for t in texts for c in t)}


class Alphabet:
    """Classes of characters: blank, letters no sample has, and each letter of the samples."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for text in texts for c in text.lower() if c.isalpha()})
        index = {c: i + 2 for i, c in enumerate(letters)}
        self.size = len(letters) + 2
        self.table = np.zeros(0x110000, np.uint8 if self.size <= 256 else np.int32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                self.table[cp] = index.get(c.lower()[:1], OTHER)

    def classes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts' characters, runs of blanks as one, and where each text begins."""
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        found = self.table[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != BLANK) | (found[:-1] != BLANK)
        keep[first[:-1][sizes > 0]] = True
        return found[keep], true_before(keep, first)


def true_before(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags before each index are true."""
    counts = np.cumsum(flags, dtype=np.int32)
    return np.where(at > 0, counts[at - 1], 0).astype(np.int64) if len(counts) else np.zeros(len(at), np.int64)


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a sequence."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


#: The most entries (int32) that a table of all states and symbols may have; beyond, transitions are hashed.
DENSE = 4_000_000
#: A multiplier that spreads keys over a hash table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """A suffix automaton over the symbols of its own sequence; stepped for many texts at a time.

    A table of all states and symbols where that is small (alphabets), else an
    open hash table of the transitions there are (at most three a character).
    """

    def __init__(self, symbols: np.ndarray, size: int):
        own = np.unique(symbols)
        self.local = np.full(size, -1, np.int32)  # symbols of all languages to this one's
        self.local[own] = np.arange(len(own))
        following = suffix_automaton(self.local[symbols])
        self.width, self.dense = len(own), len(following) * len(own) <= DENSE
        if self.dense:
            # one more column: symbols the sequence lacks, which go nowhere
            self.width += 1
            self.local[self.local < 0] = len(own)
            self.to = np.zeros((len(following), self.width), np.int32)
            for state, to in enumerate(following):
                if to:
                    self.to[state, list(to)] = list(to.values())
            self.to = self.to.ravel()
            return
        keys = np.array([s * self.width + c for s, to in enumerate(following) for c in to], np.int64)
        values = np.array([q for to in following for q in to.values()], np.int32)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.longest, at = 0, self._home(keys)
        while len(keys):
            self.longest += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys that meet, the last stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that follow by symbols (local ones); 0 where there is none."""
        if self.dense:
            return self.to[state * self.width + symbol]
        out, left = np.zeros(len(state), np.int32), np.flatnonzero(symbol >= 0)
        keys = state[left].astype(np.int64) * self.width + symbol[left]
        at = self._home(keys)
        for _ in range(self.longest):
            found = self.keys[at]
            hit = found == keys
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            if not on.any():
                break
            left, keys, at = left[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet([samples[k] for k in self.langs])
        sequences = [self.alphabet.classes([samples[k]])[0] for k in self.langs]
        self.bits = np.log2(np.maximum([len(s) for s in sequences], 2))
        self.automata = [Automaton(s, self.alphabet.size) for s in sequences]
        self.samples, self._own = samples, {}

    def own(self, lang: str) -> float:
        """Bits a character of one half of a language's sample under the other: what its own text takes, in its script."""
        if lang not in self._own:
            text = self.samples[lang]
            half = Model({lang: text[: len(text) // 2]})
            self._own[lang] = float(np.nan_to_num(half.entropies([text[len(text) // 2 :]])[0, 0]))
        return self._own[lang]

    def phrases(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of phrases [text, language]."""
        sizes = np.diff(first)
        lanes = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = first[owner] + nth * SEGMENT
        size = np.minimum(first[owner + 1] - begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(SEGMENT), "left")
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        for k, automaton in enumerate(self.automata):
            local = automaton.local[symbols]
            state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for t in range(SEGMENT):
                n = active[t]
                if not n:
                    break
                c = local[begin[:n] + t]
                to = automaton.step(state[:n], c)
                missed = to == 0
                # a phrase begins here: after one that has ended, or where the last cannot go on
                count[:n] += missed | (state[:n] == 0)
                to[missed] = automaton.step(np.zeros(missed.sum(), np.int32), c[missed])
                state[:n] = to
            out[:, k] = np.bincount(owner, count, len(sizes)).astype(np.int64)
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a character [text, language]; NaN for texts without a letter."""
        symbols, first = self.alphabet.classes(texts)
        n = np.diff(first)
        letters = true_before(symbols != BLANK, first)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = self.phrases(symbols, first) * self.bits / n[:, None]
        bits[np.diff(letters) == 0] = np.nan
        return bits


_models: dict[int, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    key = hash(tuple(sorted(samples.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def predict(docs: DataFrame, samples: dict[str, str], carry: list[str] | None = None, prefix: str = "", own: bool = False) -> DataFrame:
    """docs' columns named in ``carry`` (default: doc_id), with lang_pred, score and bits, named with ``prefix``.

    score is b2 / (b1 + b2) of the two lowest entropies (1 if there is one
    language), bits the lowest entropy (null for ``und``).
    With ``own`` there is also a column own: the bits that the language's own
    sample takes, half by half. Where ``carry`` names the text, it goes to Python once.
    """
    carry = ["doc_id"] if carry is None else carry
    text_at = carry.index("text") if "text" in carry else len(carry)
    added = [prefix + c for c in ("lang_pred", "score", "bits", *(["own"] if own else []))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples) if samples else None
        for batch in batches:
            texts, at = batch.column(text_at), 0
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held < SLICE_BYTES // 2):
                    held += sizes[to]
                    to += 1
                part = [t or "" for t in texts.slice(at, to - at).to_pylist()]
                lang, score, bits = [UNDETERMINED] * len(part), [0.0] * len(part), [None] * len(part)
                if model:
                    all_bits = model.entropies(part)
                    best = np.argsort(all_bits, axis=1, kind="stable")
                    for i in np.flatnonzero(~np.isnan(all_bits[:, 0])):
                        b = all_bits[i][best[i]]
                        lang[i], bits[i] = model.langs[best[i][0]], float(b[0])
                        score[i] = float(b[1] / (b[0] + b[1])) if len(b) > 1 else 1.0
                more = [pa.array([None if b is None else model.own(k) for k, b in zip(lang, bits, strict=True)], pa.float64())] if own else []
                kept = [c.slice(at, to - at) for c in batch.columns[: len(carry)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), *more], names=[*carry, *added])
                at = to

    rows = docs.select(*(f"`{c}`" for c in carry), *([] if text_at < len(carry) else ["text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)])
    return rows.mapInArrow(run, f"{kinds}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` double" + (f", `{added[3]}` double" if own else ""))


def held_out(doc_id: str = "doc_id"):
    """Is crc32 of the id's decimal text, modulo 4, equal to 2?"""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
