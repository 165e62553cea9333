"""Word-shingle sets as sorted arrays of 64-bit hashes, computed a document at a time with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 200_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def words(text: str | None) -> list[bytes]:
    """Maximal runs of other than ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in order; empty with fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k) * _SPREAD)
        for j in range(k):
            out = mix(out + hashes[j : j + n]) if j == k - 1 else (out + hashes[j : j + n]) * _SPREAD ^ (out >> np.uint64(32))
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct shingles of k words, ascending. With fewer words the whole sequence is one; without words none."""
    h = word_hashes(words(text))
    return np.unique(grams(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)
