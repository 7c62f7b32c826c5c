"""Word and shingle hashes of many texts at once, as numpy array steps.

A text's word hash is a polynomial hash over a fixed table of random byte
values, read off a running sum, so a chunk of texts costs a few passes over
its bytes and none over its words one by one.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15

#: Where a Python worker keeps what its tasks share.  These functions are
#: pickled by value, so their own module is a new one for each task.
KEPT = "aeromart_worker_kept"


def made_once(name: str, make: Callable):
    """What ``make`` gives, made once a Python worker."""
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(fold_case: bool) -> np.ndarray:
    """One random odd number a byte; with ``fold_case`` A-Z count as a-z."""
    return made_once(f"bytes{fold_case}", lambda: _byte_values(fold_case))


def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U)
        self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, BASE, U)]), dtype=U)
            self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, inverse, U)]), dtype=U)
        return self.up, self.down


def running(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Running sums whose differences are the hashes of substrings."""
    up, _ = made_once("powers", Powers).get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(byte_values(fold_case)[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), equal wherever they stand."""
    _, down = made_once("powers", Powers).get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each text,
    and for each text the number of words before it (one more at the end)."""
    inside = is_word[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (of the whole array, across texts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = words[:n].copy()
    for k in range(1, size):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += words[k : k + n]
    return mix(out + U(size))


def spaced_word_bytes() -> np.ndarray:
    """Word bytes: all but space and the control codes 9 to 13."""
    table = np.ones(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


def alnum_word_bytes() -> np.ndarray:
    """Word bytes: ASCII letters and digits, and all bytes beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5):
    """For each text the sorted distinct hashes of its ``size``-word shingles
    (white-space words, ASCII case folded); a text with fewer words gives
    its whole word sequence as one, a text without words none."""
    starts, ends, firsts = word_spans(data, offsets, spaced_word_bytes())
    words = span_hashes(running(data, fold_case=True), starts, ends)
    shingles = shingle_hashes(words, size)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(shingles[a : b - size + 1])
        elif b > a:
            yield shingle_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, dtype=U)
