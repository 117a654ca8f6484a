"""Benchmark decontamination under edit distance.

Texts and benchmark items are sequences of words (lower case, punctuation at the ends cut off).  An item leaks into a text if
some passage of it is within ``max_share`` of the item's words by edit distance.

1. CGK walks embed words so that edit distance becomes Hamming distance: a walk gives out the word where it stands and stays
   or moves on as a random function of step and word says.  Two walks that an edit put apart meet again by chance.
2. Bit sampling: of each of REPEATS walks three steps are sampled (the first one, which is where the window starts, and two of
   STEPS); the words that the walk gives out there are the window's key.  Walks begin at every word of a text, and share their
   steps, as a window's walk is the rest of an earlier one.  An item is in the tables once for each start within it, so a
   window that starts inside a passage finds the item, and the place where the item would start.  Nothing else finds
   candidates.
3. Candidates near each other are one region.  A region with too few of the item's words is dropped, which loses nothing;
   the others are verified by exact edit distance (best passage, free ends).

Recall: a walk from a start finds its item if the few words up to its last sampled step are as they were, or are met again.
With edits of a fifth of the words that is about one start in three, and an item of n words has some REPEATS * n starts; a test
measures 0.99 and more over random edits at the limit, and exact passages are never lost.  Items of fewer than LONG words have
two sampled steps; one for which no walk moves on within it is found by its first word alone.

The benchmark is the side that tasks hold.  Its size is checked: above ``block_bytes`` it is searched in blocks, each against
all texts.  Texts stream through tasks whole, and nothing of them is shuffled.

Defined cases: a null or wordless text has no leak, and a null or wordless item leaks nowhere; equal items are each reported;
of passages of one item that tie in a text, the first is reported; repeated rows and null ids are judged like any other; very
long texts are searched whole, in time that grows with their length; empty tables on either side give no leaks.  Columns other
than the id and the text play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import mixed

#: Walks, and the steps that may be sampled of a walk beside its first.
REPEATS, STEPS, LONG = 8, 8, 12
#: Words of texts that are searched at a time; zeros between two texts, more than a walk can pass.
BLOCK_WORDS, BETWEEN = 200_000, STEPS + 2
HITS = "doc_id long, item_id long, start_word long, end_word long, edits int, item_words int"


def cleaned(word: bytes) -> str:
    """A word as it is compared; empty for one without letters and digits."""
    text = word.decode("utf-8", "replace").lower()
    a, b = 0, len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return text[a:b]


class Symbols(dict):
    """Numbers of raw words: -1 for a word without letters or digits, 0 for one that no item has."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        text = cleaned(word)
        self[word] = n = self.vocabulary.get(text, 0) if text else -1
        return n

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def passage(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the passage of text that is nearest to pattern by edit distance, if it takes at most so many:
    fewest edits, then the first end, then the longest (bit-parallel dynamic programming, exact)."""

    def ends(p: list[int], t: list[int], free: bool) -> list[int]:
        m, eq = len(p), {}
        for k, x in enumerate(p):
            eq[x] = eq.get(x, 0) | 1 << k
        full, top, up, down, score, out = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m, []
        for x in t:
            e = eq.get(x, 0)
            xv = e | down
            xh = (((e & up) + up) ^ up) | e
            plus, minus = down | ~(xh | up) & full, up & xh
            score += bool(plus & top) - bool(minus & top)
            plus, minus = plus << 1 | (not free), minus << 1
            up, down = (minus | ~(xv | plus)) & full, plus & xv & full
            out.append(score)
        return out

    p, t = pattern.tolist(), text.tolist()
    scores = ends(p, t, True)
    best = min(scores)
    if best > most:
        return None
    end = scores.index(best)
    back = ends(p[::-1], t[: end + 1][::-1], False)
    length = max(k for k, s in enumerate(back) if s == best) + 1
    return best, end + 1 - length, end + 1


class Table:
    """One walk: which words it moves on from at which step, its sampled steps, and the items by key."""

    def __init__(self, moves: np.ndarray, steps: tuple[int, ...]) -> None:
        self.moves, self.steps = moves, steps

    def walked(self, x: np.ndarray, at: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Where walks that stand at these places at one step stand at a later one."""
        for step in range(start, stop):
            at = at + ((self.moves[x[at]] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        return at

    @staticmethod
    def joined(key: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mixed(key + word.astype(np.uint64))

    def fill(self, x: np.ndarray, starts: np.ndarray, item: np.ndarray, offset: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Enters the items at their starts in x whose walks move on between samples and stay within the item; gives them."""
        at, key, self.masks = starts, self.joined(np.zeros(len(starts), np.uint64), x[starts]), []
        keys, kept = [key], np.ones(len(starts), bool)
        for a, b in zip((0, *self.steps), self.steps):
            further = self.walked(x, at, a, b)
            kept &= (further > at) & (further < until)
            at, key = further, self.joined(key, x[further])
            keys.append(key)
        size = 1 << max(12, int(64 * kept.sum()).bit_length())
        for key in keys:  # for each sampled step a bit map of the keys so far, which few other windows pass
            found = np.zeros(size, bool)
            found[(key[kept] & np.uint64(size - 1)).astype(np.int64)] = True
            self.masks.append(found)
        order = np.argsort(key[kept], kind="stable")
        self.keys, self.item, self.offset = key[kept][order], item[kept][order], offset[kept][order]
        return item[kept]

    def candidates(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place where it would start) of each window of x whose key is in the table."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size, at, key = np.uint64(len(self.masks[0]) - 1), starts, np.zeros(len(starts), np.uint64)
        for a, b, mask in zip((0, 0, *self.steps), (0, *self.steps), self.masks):
            at = self.walked(x, at, a, b)
            key = self.joined(key, x[at])
            stay = np.flatnonzero(mask[(key & size).astype(np.int64)])
            at, key, starts = at[stay], key[stay], starts[stay]
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.item[which], np.repeat(starts, n) - self.offset[which]


class Benchmark:
    """Items ready for the search: symbols and the tables of their windows.  rows: (item_id, text)."""

    def __init__(self, rows: list[tuple[int | None, str | None]], max_share: float) -> None:
        words = [[c for w in (t or "").encode().split() if (c := cleaned(w))] for _, t in rows]
        kept = [k for k, w in enumerate(words) if w]
        self.ids = [rows[k][0] for k in kept]
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words[k]], np.int64) for k in kept]
        self.edits = [int(max_share * len(x) + 1e-9) for x in self.items]
        self.members = [frozenset(x.tolist()) for x in self.items]
        self.tables = self._tables() if self.items else []

    def _tables(self) -> list[Table]:
        rng = np.random.default_rng(11)
        sizes = np.array([len(x) for x in self.items])
        x = np.concatenate([*self.items, np.zeros(BETWEEN, np.int64)])
        begin = np.cumsum(sizes) - sizes
        item = np.repeat(np.arange(len(sizes)), sizes)
        starts, found = np.arange(len(item)), []
        entered = np.zeros(len(sizes), bool)

        def add(steps: tuple[int, ...], which: np.ndarray) -> None:
            moves = rng.integers(0, 1 << 64, len(self.vocabulary) + 1, np.uint64, endpoint=False)
            found.append(Table(moves, steps))
            entered[found[-1].fill(x, starts[which], item[which], (starts - begin[item])[which], (begin + sizes)[item[which]])] = True

        for _ in range(REPEATS):
            early = int(rng.integers(1, STEPS // 2))
            add((early, int(rng.integers(early + 1, STEPS + 1))), sizes[item] >= LONG)
            add((early,), sizes[item] < LONG)
        add((), ~entered[item] & (starts == begin[item]))
        return found

    def search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best passage for each item that leaks into each of some texts of symbols."""
        pad = np.zeros(BETWEEN, np.int64)
        x = np.concatenate([part for t in texts for part in (t, pad)] or [pad])
        sizes = np.array([len(t) + BETWEEN for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(x)
        parts = [t.candidates(x, starts) for t in self.tables]
        item, place = (np.concatenate([np.empty(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))
        if not len(item):
            return
        # a place may lie before its text, so the text is that of the place's middle
        d, n = np.array(self.edits)[item], np.array([len(i) for i in self.items])[item]
        text = np.clip(np.searchsorted(begin, np.maximum(place + n // 2, 0), "right") - 1, 0, len(texts) - 1)
        order = np.lexsort((place, item, text))
        item, place, text, d, n = item[order], place[order], text[order], d[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(text) > 0) | (np.diff(item) != 0) | (np.diff(place) > 2 * d[1:] + 1)]))
        last, best = np.append(heads[1:], len(item)) - 1, None
        lows = np.maximum(place[heads] - d[heads] - begin[text[heads]], 0)
        highs = np.minimum(place[last] + n[heads] + 2 * d[heads] - begin[text[heads]], sizes[text[heads]] - BETWEEN)
        for t, i, lo, hi in zip(text[heads].tolist(), item[heads].tolist(), lows.tolist(), highs.tolist(), strict=True):
            if best and best[:2] != (t, i):
                yield best
                best = None
            region, members, most = texts[t][lo:hi], self.members[i], self.edits[i]
            if sum(w in members for w in region.tolist()) < len(self.items[i]) - most:
                continue
            hit = passage(self.items[i], region, most)
            if hit and (best is None or hit[0] < best[2]):
                best = t, i, hit[0], lo + hit[1], lo + hit[2]
        if best:
            yield best


def _blocks(benchmark: DataFrame, item_col: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items, in blocks of about block_bytes of text; one block for any usual benchmark."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64(F.col(text)), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def _found(texts: pa.Array, items: Benchmark, symbols: Symbols) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(row, leaks) of each text that has any, with starts and ends as positions among all its words."""
    held: list[np.ndarray] = []
    size = 0

    def searched(first: int) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
        real = [np.flatnonzero(x >= 0) for x in held]
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for t, item, edits, a, b in items.search([x[r] for x, r in zip(held, real, strict=True)]):
            out.setdefault(t, []).append((item, edits, int(real[t][a]), int(real[t][b - 1]) + 1))
        yield from ((first + t, found) for t, found in out.items())

    for k, t in enumerate(texts):
        held.append(symbols.of(t.as_py() or b""))
        size += len(held[-1])
        if size >= BLOCK_WORDS:
            yield from searched(k + 1 - len(held))
            held, size = [], 0
    if held:
        yield from searched(len(texts) - len(held))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", max_share: float = 0.2, block_bytes: int = 16 << 20) -> DataFrame:
    """One row for each document and item that leaks into it: doc_id, item_id, the words of the best passage (start_word,
    end_word), its edits and the item's words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    out = None
    for block in _blocks(benchmark, item_col, text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast((block, max_share))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Benchmark(*sent.value)
            symbols = Symbols(items.vocabulary)
            for batch in batches:
                ids, got = batch.column("doc_id").to_pylist(), []
                for k, found in _found(batch.column("t"), items, symbols):
                    got += [(ids[k], items.ids[i], a, b, edits, len(items.items[i])) for i, edits, a, b in found]
                columns = list(zip(*got, strict=True)) or [()] * 6
                types = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

        part = rows.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", max_share: float = 0.2, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs into which no item leaks, unchanged."""
    for block in _blocks(benchmark, item_col, text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast((block, max_share))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Benchmark(*sent.value)
            symbols = Symbols(items.vocabulary)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for k, _ in _found(batch.column(batch.num_columns - 1), items, symbols):
                    clean[k] = False
                yield batch.filter(pa.array(clean))

        taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("binary").alias("t"))
        docs = taken.mapInArrow(run, taken.schema).select("row.*")
    return docs
