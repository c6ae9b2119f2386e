"""Word-level helpers used inside Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    """Word to 63-bit hash; forgets all when it grows large, so its memory is bounded whatever the vocabulary."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return value


def word_hashes(words: list[str], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` consecutive words; repeated runs stay."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)
