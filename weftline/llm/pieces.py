"""The piece table of a public SentencePiece model, and paths through the lattices of its pieces.

A table is small (its model file), so tasks hold it whole.  The path of the file is a parameter; nothing of it is kept here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


@dataclass
class Pieces:
    """text and score of each normal piece by id, and the id of each byte."""

    ids: dict[str, tuple[int, float]]
    bytes: list[int]
    unknown: float
    longest: int = field(init=False)
    starts: frozenset[str] = field(init=False, repr=False)
    #: Characters that some piece has next to each other.
    pairs: frozenset[tuple[str, str]] = field(init=False, repr=False)

    #: How an id is packed.
    code: np.dtype = field(init=False, repr=False)

    def __post_init__(self) -> None:
        greatest = max([i for i, _ in self.ids.values()] + self.bytes, default=0)
        self.code = np.dtype(np.uint16 if greatest < 1 << 16 else np.int32)
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = frozenset(x for p in self.ids for x in zip(p, p[1:]))
        self.starts = frozenset(p[:k] for p in self.ids for k in range(2, len(p) + 1))

    def best(self, unit: str) -> list[int]:
        """Ids of the path with the greatest sum of scores; of equal ones, where they part, that with the longest last
        piece.  A character that is no piece is its bytes."""
        n, get, starts = len(unit), self.ids.get, self.starts
        score, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            here = score[i]
            piece, value = get(unit[i]) or (-1, self.unknown)
            if here + value > score[i + 1]:
                score[i + 1], back[i + 1] = here + value, (i, piece)
            for j in range(i + 2, n + 1):
                part = unit[i:j]
                if part not in starts:  # no piece goes on like this
                    break
                found = get(part)
                if found and here + found[1] > score[j]:
                    score[j], back[j] = here + found[1], (i, found[0])
        out: list[int] = []
        while n:
            i, piece = back[n]
            out += (piece,) if piece >= 0 else [self.bytes[b] for b in reversed(unit[i:n].encode("utf-8", "replace"))]
            n = i
        return out[::-1]


def load(path: str = DEFAULT_MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, code = {}, [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            code[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[model.id_to_piece(i)] = (i, model.get_score(i))
    usual = [s for _, s in ids.values() if s > -1e8]  # runs of spaces have a score that no path takes
    return Pieces(ids, code, min(usual) - 10.0)


class Lattice:
    """Sums over all segmentations of many words at once, in log space.

    log_piece: natural log probability of each piece; log_byte: of each byte, for characters that are no piece.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str], log_piece: np.ndarray, log_byte: np.ndarray) -> None:
        self.log_piece, self.log_byte, self.n = log_piece, log_byte, len(pieces)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p in pieces}):
            which = np.array([k for k, p in enumerate(pieces) if len(p) == length])
            codes = np.array([[ord(c) for c in pieces[k]] for k in which], np.uint64)
            keys = self.hashes(codes)[:, -1]
            order = np.argsort(keys)
            self.by_length[length] = keys[order], which[order]

    @classmethod
    def hashes(cls, codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes of each row."""
        out, h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64), np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * cls.BASE + codes[:, j] + np.uint64(1)
            out[:, j + 1] = h
        return out

    def edges(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For words of one length: by length of the edge, (piece or -1, log probability) for each start, (words, starts).
        A character that is no piece has an edge of its bytes."""
        size = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)
        prefix, found, power = self.hashes(codes.astype(np.uint64)), {}, np.ones(1, np.uint64)
        for length in range(1, min(size, max(self.by_length)) + 1):
            power = power * self.BASE
            if length not in self.by_length and length > 1:
                continue
            keys, which = self.by_length.get(length, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            mine = prefix[:, length:] - prefix[:, :-length] * power
            if len(keys):
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                piece = np.where(keys[at] == mine, which[at], -1)
            else:
                piece = np.full(mine.shape, -1)
            value = np.where(piece >= 0, self.log_piece[piece], -np.inf)
            if length == 1 and (missing := piece < 0).any():
                letters, at = np.unique(codes[missing], return_inverse=True)
                value[missing] = np.array([sum(self.log_byte[b] for b in chr(c).encode("utf-8", "replace")) for c in letters.tolist()])[at]
            found[length] = piece, value
        return found

    @staticmethod
    def chunks(words: list[str]) -> list[np.ndarray]:
        """Positions of words by length, in pieces that fit a cache."""
        sizes = np.array([len(w) for w in words])
        order, out = np.argsort(sizes, kind="stable"), []
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            step = max(1, 100_000 // max(1, int(sizes[part[0]]))) if len(part) else 1
            out += [part[at : at + step] for at in range(0, len(part), step)]
        return [x for x in out if len(x)]

    @staticmethod
    def _forward(found: dict, n: int, size: int) -> np.ndarray:
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            terms = [alpha[j - length] + value[:, j - length] for length, (_, value) in found.items() if length <= j]
            top = np.maximum.reduce(terms)
            alpha[j] = top + np.log(sum(np.exp(t - top) for t in terms))
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        out = np.zeros(len(words))
        for part in self.chunks(words):
            some = [words[k] for k in part]
            if some[0]:
                out[part] = self._forward(self.edges(some), len(some), len(some[0]))[-1]
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected numbers of each piece and byte, over all segmentations of words taken weights times."""
        pieces, code = np.zeros(self.n), np.zeros(256)
        for part in self.chunks(words):
            some = [words[k] for k in part]
            if not some[0]:
                continue
            found, size, w = self.edges(some), len(some[0]), weights[part]
            alpha = self._forward(found, len(some), size)
            beta = np.full((size + 1, len(some)), -np.inf)
            beta[size] = 0
            for i in range(size - 1, -1, -1):
                terms = [beta[i + length] + value[:, i] for length, (_, value) in found.items() if i + length <= size]
                top = np.maximum.reduce(terms)
                beta[i] = top + np.log(sum(np.exp(t - top) for t in terms))
            for length, (piece, value) in found.items():
                starts = size - length + 1
                share = np.exp(alpha[:starts].T + value + beta[length:].T - alpha[-1][:, None]) * w[:, None]
                known = piece >= 0
                pieces += np.bincount(piece[known], share[known], self.n)
                if length == 1 and not known.all():
                    for row, i in np.argwhere(~known).tolist():
                        for b in some[row][i].encode("utf-8", "replace"):
                            code[b] += share[row, i]
        return pieces, code
