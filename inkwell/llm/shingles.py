"""Five-word shingles and min-hash bands, computed for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import xxhash

SHINGLE, SIMILARITY = 5, 0.8
#: 12 bands of 4 rows: a pair at 0.8 is missed with probability 0.002.
BANDS, ROWS = 12, 4
#: Shingles whose hashes are made at once, so that they stay in the core's cache.
AT_ONCE = 32_768
#: Word hashes that one Python worker remembers; emptied when full.
REMEMBERED = 500_000
_rng = np.random.default_rng(11)
_odd = lambda n: _rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _PLACE, _BAND = _odd(BANDS * ROWS), _odd(SHINGLE), _odd(ROWS)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_SALT = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


class Hashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


hashes = Hashes()


def word_hashes(words: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: Sequence[str]) -> np.ndarray:
    """Hashes of the text's five-word shingles; a shorter text is one shingle."""
    return _roll(word_hashes(words)) if len(words) >= SHINGLE else _roll(np.pad(word_hashes(words), (0, SHINGLE - len(words))))


def _roll(h: np.ndarray) -> np.ndarray:
    s = np.correlate(h, _PLACE, "valid")
    return s ^ (s >> np.uint64(29))


def bands(texts: Sequence[Sequence[str]]) -> list[list[int]]:
    """Band hashes of each text of a batch; none for a text without a full shingle."""
    out: list[list[int]] = [[] for _ in texts]
    long = [i for i, w in enumerate(texts) if len(w) >= SHINGLE]
    if not long:
        return out
    n = np.array([len(texts[i]) for i in long])
    s = _roll(word_hashes(list(chain.from_iterable(texts[i] for i in long))))
    start = np.concatenate(([0], np.cumsum(n)[:-1]))
    inside = np.ones(start[-1] + n[-1], bool)  # positions whose shingle stays in one text
    for j in range(1, SHINGLE):
        inside[start + n - j] = False
    s = s[np.flatnonzero(inside)]
    sig = _least(s, np.concatenate(([0], np.cumsum(n - SHINGLE + 1)))).T
    with np.errstate(over="ignore"):
        mixed = (sig.reshape(len(long), BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) ^ _SALT
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _A[0]
    for i, row in zip(long, mixed.view(np.int64).tolist(), strict=True):
        out[i] = row
    return out


def _least(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(function, text): the least value of each hash function over the shingles between a text's bounds."""
    out = np.empty((BANDS * ROWS, len(bounds) - 1), np.uint64)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + AT_ONCE, "right")) - 1)
        some, first = s[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        hashed = np.empty_like(some)
        for k in range(BANDS * ROWS):
            np.multiply(some, _A[k], out=hashed)
            hashed += _B[k]
            out[k, lo:hi] = np.minimum.reduceat(hashed, first)
        lo = hi
    return out
