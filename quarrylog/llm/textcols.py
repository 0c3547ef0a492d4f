"""Vectorised word handling on Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; all of these are
ASCII, so UTF-8 texts can be cut on bytes. Work proceeds in slices of bounded
size, however large the Arrow batches are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes handled at a time (one text may be longer).
SLICE_BYTES = 2 << 20
#: Bytes whose words are hashed at a time.
BLOCK_BYTES = 1 << 18
#: Odd multipliers of the two independent families of word hashes.
_FAMILIES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of more bytes than this are hashed one at a time.
LONG_WORD = 256
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x *= U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(33)
    return x


class Slice:
    """Consecutive texts of a batch: their bytes, and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word; index of each text's first word (n + 1 values)."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        inside = _IS_WORD[self.data]
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | cut[1:-1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, self.offsets)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the two families are independent.

    Eight bytes at a time go through the finaliser, so that no sum or product of
    positions can cancel out; long words take a keyed BLAKE2b digest.
    """
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, origin + BLOCK_BYTES, "right")))
        out[at:to] = _block_hashes(data[origin : ends[to - 1]], starts[at:to] - origin, ends[at:to] - origin, family)
        at = to
    return out


def _block_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    factor, sizes = U(_FAMILIES[family]), ends - starts
    padded = np.zeros(len(block) + 8, np.uint8)
    padded[: len(block)] = block
    at_byte = np.lib.stride_tricks.as_strided(padded[:8].view(U), (len(block) + 1,), (1,))
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -LONG_WORD, "left") :]
    left, place = sizes[order], starts[order]
    with np.errstate(over="ignore"):
        state = mix(left.astype(U) * factor + U(family + 1))
        n = len(order)
        while n:
            chunk = at_byte[place[:n]]
            short = np.maximum(8 - left[:n], 0).astype(U) * U(8)
            chunk = chunk & (U(0xFFFFFFFFFFFFFFFF) >> short)
            state[:n] = mix((state[:n] ^ chunk) * factor + U(family + 1))
            place[:n] += 8
            left[:n] -= 8
            n = int(np.searchsorted(-left[:n], 0, "left"))
    out = np.empty(len(starts), U)
    out[order] = state
    for i in np.flatnonzero(sizes > LONG_WORD):
        digest = hashlib.blake2b(block[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"word%d" % family).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def gram_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words (runs may cross texts; see inside()), from those of half the length."""
    if len(words) < size:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out, have = mix(words + U(2 * seed + 1)), 1
        while have < size:
            step = min(have, size - have)
            out = mix(out[:-step] * U(_FAMILIES[0]) + (out[step:] ^ (out[step:] >> U(29))) * U(_FAMILIES[1]) + U(have))
            have += step
    return out


def inside(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each of the n run starts: does the run end within its own text?"""
    counts = np.diff(first)
    return np.arange(n) + size <= np.repeat(first[1:], counts)[:n]



def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words one after the other, a blank behind each, and where each begins (n + 1 values).

    A word of more than LONG_WORD bytes is represented by its first 64 bytes, byte 0xFF and its SHA-256 digest.
    """
    sizes = ends - starts
    long = np.flatnonzero(sizes > LONG_WORD)
    if len(long):
        pieces, at = [], 0
        for i in [*long.tolist(), len(starts)]:
            if i > at:
                pieces.append(plain_words(data, starts[at:i], ends[at:i])[0])
            if i < len(starts):
                word = data[starts[i] : ends[i]].tobytes()
                pieces.append(word[:64] + b"\xff" + hashlib.sha256(word).hexdigest().encode() + b" ")
            at = i + 1
        sizes = np.where(sizes > LONG_WORD, 64 + 1 + 64, sizes)
        return b"".join(pieces), np.concatenate([[0], np.cumsum(sizes + 1)])
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(first[-1], 32, np.uint8)
    source = np.repeat(starts - first[:-1], sizes) + (inside_word := np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes))
    out[inside_word] = data[source]
    return out.tobytes(), first
