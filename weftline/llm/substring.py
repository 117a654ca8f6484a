"""Removal of repeated passages: words covered by a window of ``window`` words that also starts earlier in the corpus.

1. Every window is named by its minimizer, the least hash among its GRAM-word grams; equal windows have equal minimizers.
   Neighbouring windows with one minimizer form a segment, so there is one row for about eight windows.  A row has a second
   hash, of all the segment's words.
2. Segments with equal hashes are copies: all but the one at the first place go as a whole.  They are collapsed before each
   shuffle (a block of texts at a time), and met again dealt by minimizer and a part of the second hash, so a passage that very
   many documents share, or go on from each in its own way, is dealt over many tasks.
3. A second, smaller shuffle by minimizer alone leaves out the segments whose minimizer nothing else has.  What is left,
   different segments with one minimizer and those that can repeat within themselves, is asked for.
4. The words of the segments asked for (as hashes) are dealt by minimizer into shards.  Each shard is a compressed FM-index of
   bounded size; its segments are streamed through it, and backward search gives for each window the first place where it
   starts.  Windows whose first place is an earlier one are reported as intervals.
5. The different segments of a hot minimizer, counted before words are shipped, would pass the bound of a shard.  They are cut
   again by minimizers of longer grams (CONTEXTS), only as long as what shares one is still too much, so that a shard's index
   holds windows that share more of what is around a frequent passage.  Equal windows have equal minimizers of any length, so
   they stay together.  In the end the gram is the window itself, and all that shares one is equal.
6. Intervals meet their documents by id.

Words are compared as written, by 64-bit hashes: two windows are equal if all their words' hashes are, in order; a copy of a
segment is one with equal minimizer and equal hash of all words, 128 bits together.  Windows are judged on the input, not on
what is left.

Defined cases: a null or wordless text has no words, and the hash of an empty text; a text shorter than the window loses
nothing; very long texts are cut into segments like others, and one text is the least that a task holds.  Rows with a null id
have no place in the order: they lose nothing and take nothing from others.  Rows that repeat an id are one document (with
equal texts: both lose what one would).  An empty table gives no rows.  Columns other than the id and the text play no part,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.fm_index import FMIndex
from weftline.llm.shared import written
from weftline.llm.words import P, WordHashes, mixed, windows

GRAM = 6
#: Words of the longer grams by which what shares a hot minimizer is cut again, before the window itself.
CONTEXTS = (10, 14)
#: Above so many words the different segments of one minimizer are cut by longer grams.  A shard's index holds at most their sum
#: with SHARD_WORDS, which takes about 50 MB while it is built.
HOT_WORDS, SHARD_WORDS = 200_000, 250_000
#: Words of the texts that are cut into segments, and collapsed, at a time; parts that one minimizer's segments are dealt into.
BLOCK_WORDS, PARTS = 200_000, 256
SALTS = 16
CUT, ASKED, ALONE, SHARED = range(4)
#: at packs where a segment starts, its windows, and whether one of them can repeat within it; it sorts by start.
ROW = "m long, h long, doc_id long, at long, cut boolean"
STATE = "m long, doc_id long, at long, kind byte, part int"
WORDS = "key long, doc_id long, start int, twice boolean, words binary, size int"
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.bool_())
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def packed(start: np.ndarray, n: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | n.astype(np.int64) << 1 | twice


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of P, and of its inverse."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(P), -1, 1 << 64))
        for k, base in enumerate((P, inverse)):
            x = np.full(max(n, 2 * BLOCK_WORDS), base)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def segments(x: np.ndarray, owner: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimizer, hash of all words, first word, windows, whether a window can repeat within it) of each run of windows with
    one minimizer.  x: word hashes of texts one after the other; owner: the text of each word."""
    n, wide = len(x) - window + 1, window - gram + 1
    at = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n > 0 else np.empty(0, np.int64)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), at, at, np.empty(0, bool)
    grams = windows(x, gram)
    least, span = grams, 1
    while span < wide:
        step = min(span, wide - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    heads = np.flatnonzero(np.concatenate([[True], (least[at[1:]] != least[at[:-1]]) | (np.diff(at) > 1) | (np.diff(owner[at]) > 0)]))
    first, sizes = at[heads], np.diff(np.append(heads, len(at)))
    m = least[first]
    # a window repeats within a run only if the run has its minimizer at two places
    spans = sizes + wide - 1
    begin = np.cumsum(spans) - spans
    inner = np.repeat(first - begin, spans) + np.arange(spans.sum())
    twice = np.add.reduceat(grams[inner] == np.repeat(m, spans), begin) > 1
    up, down = powers(len(x))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * down[: len(x)])])
    whole = (sums[first + sizes + window - 1] - sums[first]) * up[first]
    return m, mixed(whole + sizes.astype(np.uint64)), first, sizes, twice & (sizes > 1)


def first_places(m: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their content, in order, and rows that repeat one at an earlier place."""
    order = np.lexsort((at, doc, h, m))
    m, h, doc, at = m[order], h[order], doc[order], at[order]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (h[1:] != h[:-1])]) if len(m) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    return order[new], order[~new & ((doc != doc[head]) | (at != at[head]))]


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _segment_rows(docs: DataFrame, window: int) -> DataFrame:
    """ROW for each segment that is the first of its content in a block of texts; and, as cut, for each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        held: list[np.ndarray] = []
        ids: list[int] = []
        size = 0

        def rows() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], np.int64)
            x, owner = np.concatenate([*held, np.empty(0, np.uint64)]), np.repeat(np.arange(len(held)), sizes)
            m, h, first, n, twice = segments(x, owner, window)
            text = owner[first]
            doc, at = np.array(ids, np.int64)[text], packed(first - (np.cumsum(sizes) - sizes)[text], n, twice)
            m, h = m.view(np.int64), h.view(np.int64)
            firsts, copies = first_places(m, h, doc, at)
            spread = mixed((doc[copies] ^ at[copies] << 20).view(np.uint64)).view(np.int64)  # nothing is looked up by it
            out = [np.concatenate([c[firsts], d]) for c, d in ((m, spread), (h, spread), (doc, doc[copies]), (at, at[copies]))]
            return _batch(ROW, *out, np.arange(len(out[0])) >= len(firsts))

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                x = words.of((t.as_py() or b"").split())
                if len(x) >= window:
                    held.append(x)
                    ids.append(i)
                    size += len(x)
                if size >= BLOCK_WORDS:
                    yield rows()
                    held, ids, size = [], [], 0
        if held:
            yield rows()

    return docs.mapInArrow(run, ROW)


def _met(found: DataFrame) -> DataFrame:
    """STATE of the segments that met those with their minimizer and part of the second hash: copies to cut; ASKED for; or
    ALONE so far, for which SHARED rows stand for the others.  Sorted rows stream by, and one of them is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first row of the last content; whether it has been given out; whether its minimizer is shared
        last, given, shared = None, False, False

        def judged(x: list[np.ndarray], end: bool) -> tuple[pa.RecordBatch, tuple | None, bool, bool]:
            m, h, doc, at = x
            new_m = np.concatenate([[True], m[1:] != m[:-1]])
            new = new_m | np.concatenate([[True], h[1:] != h[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
            copies = ~new & ((doc != doc[head]) | (at != at[head]))
            heads = np.flatnonzero(new_m)
            ours = np.add.reduceat(np.where(new, np.where(at & 1, 2, 1), 0), heads) > 1
            ours[0] |= shared
            firsts = np.flatnonzero(new)
            group = np.searchsorted(heads, firsts, "right") - 1
            out = np.ones(len(firsts), bool)
            out[0] = not given  # the remembered row
            keep = None, False, False
            if not end:
                k = firsts[-1]
                keep = tuple(c[k] for c in x), bool(ours[-1]), bool(ours[-1])
                if not ours[-1]:
                    out[-1] = False
            firsts, asked, group = firsts[out], ours[group[out]], group[out]
            witness = heads[np.unique(group[asked])]
            rows = np.concatenate([np.flatnonzero(copies), firsts, witness])
            kind = np.concatenate([np.full(copies.sum(), CUT), np.where(asked, ASKED, ALONE), np.full(len(witness), SHARED)]).astype(np.int8)
            part = np.where((kind == ALONE) | (kind == SHARED), 0, mixed((doc[rows] ^ at[rows]).view(np.uint64)) >> np.uint64(40)).astype(np.int32)
            return _batch(STATE, m[rows], doc[rows], at[rows], kind, part), *keep

        for batch in batches:
            cut = batch.column("cut").to_numpy(zero_copy_only=False)
            x = [batch.column(c).to_numpy() for c in ("m", "h", "doc_id", "at")]
            if cut.any():
                m, _, doc, at = (c[cut] for c in x)
                yield _batch(STATE, m, doc, at, np.full(len(m), CUT, np.int8), np.zeros(len(m), np.int32))
                x = [c[~cut] for c in x]
            if len(x[0]):
                if last is not None:
                    x = [np.concatenate([[v], c]) for v, c in zip(last, x, strict=True)]
                else:
                    given = shared = False
                out, last, given, shared = judged(x, False)
                yield out
        if last is not None:
            yield judged([np.array([v]) for v in last], True)[0]

    dealt = found.repartition(F.col("m"), F.pmod("h", F.lit(PARTS)))
    return dealt.sortWithinPartitions("m", "h", "doc_id", "at").mapInArrow(run, STATE)


def _asked(met: DataFrame) -> DataFrame:
    """STATE of the segments to cut and to ask for, now that all those with one minimizer are together (few for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark = None, None  # rows of the last minimizer that may yet be alone; it, if it is known to be shared

        def judged(x: list[np.ndarray], end: bool) -> tuple[pa.RecordBatch, list[np.ndarray] | None, int | None]:
            m, doc, at, kind, part = x
            heads = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            ours = np.add.reduceat(np.where(kind == ALONE, 1, np.where(kind == CUT, 0, 2)), heads) > 1
            ours[0] |= mark is not None and int(m[0]) == mark
            going = None, int(m[-1])
            stay = np.ones(len(m), bool)
            if not end and not ours[-1]:
                stay[heads[-1] :] = False
                going = [c[heads[-1] :] for c in x], None
            shared = np.repeat(ours, np.diff(np.append(heads, len(m))))
            rows = stay & ((kind == CUT) | (kind == ASKED) | (kind == ALONE) & shared)
            return _batch(STATE, m[rows], doc[rows], at[rows], np.where(kind[rows] == CUT, CUT, ASKED).astype(np.int8), part[rows]), *going

        names = [x.split()[0] for x in STATE.split(", ")]
        for batch in batches:
            if batch.num_rows:
                x = [batch.column(c).to_numpy() for c in names]
                x = [np.concatenate(pair) for pair in zip(held, x, strict=True)] if held is not None else x
                out, held, mark = judged(x, False)
                yield out
        if held is not None:
            yield judged(held, True)[0]

    return met.repartition("m", "part").sortWithinPartitions("m").mapInArrow(run, STATE)


def _word_rows(got: list[tuple], hot: bool) -> pa.RecordBatch:
    """WORDS, and with hot the flag, of tuples."""
    names = [x.split()[0] for x in WORDS.split(", ")] + ["hot"] * hot
    columns = list(zip(*got, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=False)], names=names)


def _marked(rows: DataFrame, keys: DataFrame, key: str, part: Column) -> DataFrame:
    """rows with hot, whether their key is one of keys (of); a key's rows are dealt over PARTS."""
    dealt = keys.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = rows.join(dealt.hint("shuffle_hash"), (F.col(key) == F.col("of")) & (F.pmod(part, F.lit(PARTS)) == F.col("s")), "left")
    return met.withColumn("hot", F.col("of").isNotNull()).drop("of", "s")


def _segment_words(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """WORDS of the segments asked for; with null words, intervals to cut."""
    n = F.shiftright(F.col("at").bitwiseAND(0xFFFFFFFF), 1)
    keys = written(asked.groupBy("m").agg(F.sum(n + window - 1).alias("w")).where(F.col("w") > HOT_WORDS).select(F.col("m").alias("of")), "hot")
    none = keys.isEmpty()
    marked = asked.withColumn("hot", F.lit(False)) if none else _marked(asked, keys, "m", F.col("part"))
    lists = marked.groupBy("doc_id").agg(F.collect_list(F.struct("m", "at", "hot")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        got: list[tuple] = []
        size = 0
        for batch in batches:
            fields = batch.column("s")
            for k, (i, t) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True)):
                x = words.of((t.as_py() or b"").split())
                for m, at, hot in sorted(zip(*[y.to_pylist() for y in fields[k].values.flatten()], strict=True), key=lambda y: y[1]):
                    start, n = at >> 32, (at & 0xFFFFFFFF) >> 1
                    end = start + n + window - 1
                    if end > len(x):
                        continue  # of another text with this id
                    got.append((m, i, start, bool(at & 1), x[start:end].tobytes(), end - start, hot))
                    size += 8 * (end - start)
                    if size > 8 << 20:
                        yield _word_rows(got, True)
                        got, size = [], 0
        yield _word_rows(got, True)

    rows = docs.join(lists, "doc_id").select("doc_id", "t", "s").mapInArrow(run, WORDS + ", hot boolean")
    return rows.drop("hot") if none else _by_context(written(rows, "words"), window)


def _by_context(rows: DataFrame, window: int) -> DataFrame:
    """WORDS of rows (WORDS and hot), the hot ones cut by longer grams until what shares one fits a shard."""
    done, hot = rows.where("not hot").drop("hot"), rows.where("hot").drop("hot")
    for gram in [g for g in CONTEXTS if GRAM < g < window]:
        cut = written(_recut(hot, window, gram), "context")
        sizes = cut.where("words is not null").groupBy("key").agg(F.sum("size").alias("w"))
        keys = written(sizes.where(F.col("w") > HOT_WORDS).select(F.col("key").alias("of")), "hot")
        if keys.isEmpty():
            return done.unionByName(cut)
        marked = _marked(cut, keys, "key", F.xxhash64("doc_id", "start"))
        still = F.col("hot") & F.col("words").isNotNull()
        done, hot = done.unionByName(marked.where(~still).drop("hot")), marked.where(still).drop("hot")
    return done.unionByName(_recut(hot, window, window))


def _recut(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """WORDS of the segments that those of rows (WORDS) have by minimizers of gram words.  Of equal ones in a batch one is kept
    with its words, unless an earlier one comes after it; the others are intervals to cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
            lengths = np.array([len(w) for w in held])
            x, owner = np.concatenate(held), np.repeat(np.arange(len(held)), lengths)
            m, _, first, n, twice = segments(x, owner, window, gram)
            row = owner[first]
            key = mixed(batch.column("key").to_numpy().view(np.uint64)[row] ^ m).view(np.int64).tolist()
            doc = batch.column("doc_id").to_numpy()[row].tolist()
            start = (batch.column("start").to_numpy()[row] + first - (np.cumsum(lengths) - lengths)[row]).tolist()
            seen: dict[bytes, tuple[int, int]] = {}
            got: list[tuple] = []
            for k, i, at, a, windows_of, again in zip(key, doc, start, first.tolist(), n.tolist(), twice.tolist(), strict=True):
                if gram == window and windows_of > 1:  # one window over and over: the first stands for it
                    got.append((k ^ i ^ at, i, at + 1, False, None, windows_of + window - 2))
                    windows_of, again = 1, False
                size = windows_of + window - 1
                own = x[a : a + size].tobytes()
                before = seen.setdefault(own, (i, at))
                if before < (i, at):
                    got.append((k ^ i ^ at, i, at, False, None, size))
                else:
                    seen[own] = (i, at)
                    got.append((k, i, at, again, own, size))
            yield _word_rows(got, False)

    return rows.mapInArrow(run, WORDS)


class Group:
    """The different segments of one key, each with its first place."""

    def __init__(self) -> None:
        self.first: dict[bytes, tuple[int, int]] = {}
        self.words, self.twice = 0, False

    def add(self, i: int, start: int, twice: bool, words: bytes) -> bool:
        """Whether this is a copy of a segment at an earlier place; places come in order."""
        if words in self.first:
            return self.first[words] != (i, start)
        self.first[words] = (i, start)
        self.words += len(words) // 8
        self.twice |= twice
        return False

    def repeats(self) -> bool:
        """Whether a window of one segment can be in another, or twice in one."""
        return len(self.first) > 1 or self.twice


def shard_repeats(held: list[Group], window: int) -> list[tuple[int, int, int]]:
    """Intervals (doc_id, from, to) of the repeated windows of a shard's segments."""
    rows = sorted((place, words) for g in held for words, place in g.first.items())
    sizes = np.array([len(words) // 8 for _, words in rows])
    ends = np.cumsum(sizes)
    names, symbols = np.unique(np.frombuffer(b"".join(words for _, words in rows), np.uint64), return_inverse=True)
    texts = np.split(symbols.reshape(-1) + 1, ends[:-1])
    index = FMIndex(texts, len(names), window)
    found, n = np.concatenate(index.matches(texts)), sizes - window + 1
    own = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
    docs, starts = np.array([i for (i, _), _ in rows]), np.array([s for (_, s), _ in rows])
    again = np.flatnonzero(found < index.starts[own] + at)
    own, at, found = own[again], at[again], found[again]
    other = np.searchsorted(index.starts, found, "right") - 1
    theirs, place = starts[other] + found - index.starts[other], starts[own] + at
    real = (docs[other] < docs[own]) | (docs[other] == docs[own]) & (theirs < place)  # not the place itself, given twice
    own, place = own[real], place[real]
    if not len(own):
        return []
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(own) > 0) | (np.diff(place) > 1)]))
    last = np.append(heads[1:], len(own)) - 1
    return list(zip(docs[own[heads]].tolist(), place[heads].tolist(), (place[last] + window).tolist(), strict=True))


def _shards(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, a, b): intervals to remove."""
    schema = "doc_id long, a int, b int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[Group] = []
        group, last, size = Group(), None, 0

        def given() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "twice", "words", "size")]
            for key, i, start, twice, words, n in zip(*columns, strict=True):
                if words is None:
                    out.append((i, start, start + n))
                    continue
                if key != last:
                    if group.repeats():
                        held.append(group)
                        size += group.words
                    if size >= SHARD_WORDS:
                        out += shard_repeats(held, window)
                        held, size = [], 0
                    group, last = Group(), key
                if group.add(i, start, twice, words):
                    out.append((i, start, start + n))
                if len(out) > 50_000:
                    yield given()
                    out = []
        if group.repeats():
            held.append(group)
        if held:
            out += shard_repeats(held, window)
        yield given()

    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(run, schema)


def repeated(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, a, b): intervals of words to remove.  docs: (doc_id, t), t in UTF-8."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    found = written(_asked(_met(_segment_rows(docs, window))), "segments")
    start, n = F.shiftright("at", 32).cast("int"), F.shiftright(F.col("at").bitwiseAND(0xFFFFFFFF), 1).cast("int")
    whole = found.where(F.col("kind") == CUT).select("doc_id", start.alias("a"), (start + n + window - 1).alias("b"))
    return whole.unionByName(_shards(_segment_words(docs, found.where(F.col("kind") == ASKED), window), window))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (the words that stay, joined by one space) for each row of
    docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    cuts = repeated(rows.where("doc_id is not null"), window)
    lists = cuts.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sums, kept = [], [], [], []
            for t, cuts in zip(batch.column("t"), batch.column("cuts").to_pylist(), strict=True):
                words = (t.as_py() or b"").split()
                n.append(len(words))
                if cuts:
                    stay, at = [], 0
                    for a, b in sorted((x["a"], x["b"]) for x in cuts):
                        stay += words[at:a]
                        at = max(at, b)
                    words = stay + words[at:]
                removed.append(n[-1] - len(words))
                whole = b" ".join(words)
                sums.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    kept.append(whole.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if with_text else [])], names=out)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    out = [x.split()[0] for x in schema.split(", ")]
    return rows.join(lists, "doc_id", "left").select("doc_id", "t", "cuts").mapInArrow(run, schema)
