"""Content-selected positions: the smallest word-gram hash of each window of words."""

from __future__ import annotations

import numpy as np

from quarrylog.llm import textcols as tc

U = np.uint64
_PLACE_BITS = 24


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (its top 40 bits; the leftmost of equals) in each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    top = values >> U(_PLACE_BITS)
    if len(values) < 1 << _PLACE_BITS:
        least, have = top << U(_PLACE_BITS) | np.arange(len(values), dtype=U), 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return (least & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    best, at = top[:n].copy(), np.arange(n)
    for i in range(1, width):
        less = top[i : i + n] < best
        np.copyto(best, top[i : i + n], where=less)
        at[less] = np.flatnonzero(less) + i
    return at


def selected(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``window`` words within one text: its start, the position selected in it, and all gram hashes.

    Two equal windows select the same gram at the same distance from their starts.
    """
    n = len(words) - window + 1
    grams = tc.gram_hashes(words, gram)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, grams
    starts = np.flatnonzero(tc.inside(first, n, window))
    return starts, sliding_argmin(grams, window - gram + 1)[starts], grams
