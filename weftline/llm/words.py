"""Words of a text as numbers: small numpy helpers that run inside tasks.

A word is a run of bytes other than ASCII white space, which is what ``bytes.split`` gives.
"""

from __future__ import annotations

import numpy as np
import xxhash

P = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, each computed once; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= P
        out += hashes[i : n + i]
    return mixed(out)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of k-word shingles; a shorter text that has words is one shingle of all of them."""
    if len(hashes) == 0:
        return hashes
    return np.unique(windows(hashes, min(k, len(hashes))) + np.uint64(min(k, len(hashes))))
