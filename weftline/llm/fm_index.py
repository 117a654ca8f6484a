"""A compressed FM-index over words, searched for many texts in step.

The Burrows-Wheeler transform of a shard is held as a wavelet matrix: for each bit of a symbol one packed bit vector with
counts every 64 places.  Backward search extends many patterns to the left at once, one word a step, so numpy does the work.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Rank of any symbol in a sequence of symbols."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, BitVector(bits.astype(np.uint8)), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place that a prefix of the sequence reaches below all levels; its difference between two prefixes counts the
        symbol between them."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index over segments of words (arrays of symbols from 1); the segments are in the order of their first places.

    ``depth`` is the length of the windows that are asked for: blocks of suffixes that agree in their first depth words are
    marked in a bit vector, which takes the part of a suffix tree's parent when a match grows beyond depth.
    """

    def __init__(self, segments: list[np.ndarray], symbols: int, depth: int) -> None:
        self.depth = depth
        sizes = np.array([len(s) for s in segments])
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros((sizes + 1).sum(), np.int64)
        text[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = np.concatenate(segments)
        n, rank, width, at_depth = len(text), text.copy(), 1, text
        exact = {1: rank}
        while width <= depth:  # a match grows to depth + 1 words before it is cut back
            step = min(width, depth - width) if width < depth else 1
            part = exact.get(step)
            if part is None:  # depth is not a power of two: its rest is made of the powers that are known
                rest, part, have = step, None, 0
                for w in sorted((w for w in exact), reverse=True):
                    while rest >= w:
                        piece = self._shifted(exact[w], have)
                        part = piece if part is None else self._ranked(part, piece)
                        rest, have = rest - w, have + w
            rank = self._ranked(rank, self._shifted(part, width))
            width += step
            exact[width] = rank
            if width == depth:
                at_depth = rank
        self.order = np.argsort(rank, kind="stable")
        bwt = text[self.order - 1]
        self.first = np.searchsorted(text[self.order], np.arange(symbols + 2))
        self.wavelet = WaveletMatrix(bwt, symbols + 1)
        block = at_depth[self.order]
        heads = np.concatenate([[True], block[1:] != block[:-1]])
        self.blocks = BitVector(heads.astype(np.uint8))
        self.block_at = np.flatnonzero(heads)
        self.earliest = np.minimum.reduceat(self.order, self.block_at)
        self.block_end = np.append(self.block_at[1:], n)
        self.base = self.wavelet.descend(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    @staticmethod
    def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), np.int64)]) if by else rank

    @staticmethod
    def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].reshape(-1)

    def back(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search for one end of each interval."""
        return self.first[symbols] + self.wavelet.descend(symbols, at) - self.base[symbols]

    def found(self, windows: np.ndarray) -> np.ndarray:
        """The first place of each row of windows (n, depth), or -1."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.order))
        known = ((windows > 0) & (windows < len(self.first) - 1)).all(axis=1)
        for c in np.where(known[:, None], windows, 0).T[::-1]:
            lo, hi = self.back(c, lo), self.back(c, hi)
        there = known & (lo < hi)
        return np.where(there, self.earliest[self.blocks.rank(np.where(there, lo, 0) + 1) - 1], -1)

    def matches(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of depth words in each text, the first place in the index where it starts, or -1.

        Backward search from the right; each text holds its longest match, cut back to depth words (matching statistics
        above the threshold are all that is asked for).  A text in which a word or an extension does not occur is searched
        window by window instead.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        lo, hi = np.zeros(len(texts), np.int64), np.full(len(texts), len(self.order))
        flat = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64)
        offset, out, broken = np.cumsum(sizes) - sizes, np.full(len(flat), -1, np.int64), np.zeros(len(texts), bool)
        for step in range(int(sizes.max(initial=0))):
            live = order[: np.searchsorted(-sizes[order], -step, "left")]
            live = live[~broken[live]]
            place = offset[live] + sizes[live] - 1 - step
            c = flat[place]
            known = (c > 0) & (c < len(self.first) - 1)
            c = np.where(known, c, 0)
            a, b = np.split(self.back(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]])), 2)
            broken[live] = ~known | (a >= b)
            if step + 1 >= self.depth:
                k = self.blocks.rank(a + 1) - 1
                a, b = self.block_at[k], self.block_end[k]
                out[place] = self.earliest[k]
            lo[live], hi[live] = a, b
        found = [out[o : o + max(0, s - self.depth + 1)] for o, s in zip(offset, sizes, strict=True)]
        for k in np.flatnonzero(broken & (sizes >= self.depth)):
            found[k] = self.found(np.lib.stride_tricks.sliding_window_view(np.asarray(texts[k], np.int64), self.depth))
        return found
