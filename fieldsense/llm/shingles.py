"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


class _Words(dict):
    """Hash by word; forgets all when it holds too many."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _M2
    return h ^ (h >> _SHIFT)


class Shingler:
    """Distinct shingles of `size` words; words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, size: int):
        self.size, self.words = size, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted hashes; of a text with fewer words, one for the whole sequence; none without words."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        n = len(words) - k + 1
        out = mixed(h[:n] + np.uint64(k))
        for j in range(1, k):
            out = mixed(out * _M1 + h[j : j + n])
        return np.unique(out)
