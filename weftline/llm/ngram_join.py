"""Jaccard self-join over word n-grams with Bayesian pruning of candidates.

1. Each text becomes its set of five-word shingles (64-bit hashes), a hash of that set, and MinHash band keys.
2. Texts with equal sets form a copy class; only its representative (smallest id) goes on.
3. Representatives that share a band key are connected to the smallest of them: as many edges as members, never all pairs.
   The components of these edges are the candidate groups.
4. Within a group a text is written relative to the group's base (the text of its smallest id): one bit for each shingle of
   the base, and the shingles that the base lacks.  That takes a near copy from some kilobytes to a few hundred bytes, and
   loses nothing.
5. A group is compared in units of two blocks, of at most BLOCK texts and about BLOCK_BYTES of shingles each; most groups have
   one.  Within a unit, MinHash values are compared a few at a time; a pair is dropped once the posterior probability that its
   similarity reaches the threshold (uniform prior, binomial likelihood) is below ``tolerance``.  What remains is verified
   exactly on the shingle sets.
6. Units give back counts and a spanning forest of their links, so rows grow with the texts and not with the pairs.  A group
   of m different texts is sent on m / BLOCK times in its short form, and its pairs are looked at once, as every text has
   its exact number of links.

Candidates: with 32 bands of 5 values a pair at similarity 0.8 shares no band with probability 3e-6 (0.9: 3e-13); pairs of
one group are compared even if they share none.  Wholly covered texts, whatever their length.

Defined cases: a text of one to four words is a single shingle; a text without words (null, empty) is like nothing, not even
like another such text.  A null id gives a row with null class and no links.  Rows that repeat an id with the same text count
as copies (``deduplicated`` keeps one of them); rows of one id with different texts share their links, and a pair of such rows
is no link itself.  Similarities that tie with the threshold are links.  An empty table gives no rows.  Other columns of the
rows play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.shared import written
from weftline.llm.words import WordHashes, mixed, shingles

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Texts and bytes of shingles of a block; rows of a unit that are compared with the others at a time.
BLOCK, BLOCK_BYTES, AT_ONCE = 4096, 32 << 20, 128
SALTS = 16
STEP = 16

_rng = np.random.default_rng(7)
MULTIPLY = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, np.uint64)


def minhash(found: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        x = found[None, at : at + 512] * MULTIPLY[:, None]
        x += ADD[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in signature.reshape(BANDS, ROWS).T:
        keys = mixed(keys + part)
    return keys.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """At n compared values, the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(STEP, HASHES + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def pruned(a: np.ndarray, b: np.ndarray, signatures: np.ndarray, fewest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are left after all values have been compared, STEP at a time.  Of each value its low byte is compared:
    a pair may match more often by that, and never less."""
    matches = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        part = signatures[:, at : at + STEP]
        matches += np.count_nonzero(part[a] == part[b], axis=1)
        stay = matches >= fewest[at + STEP]
        if not stay.all():
            a, b, matches = a[stay], b[stay], matches[stay]
        if not len(a):
            break
    return a, b


def common(a: np.ndarray, b: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """How many values the lists of each pair share."""
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    lists, (a, b) = [lists[k] for k in used], np.split(place.reshape(-1), 2)
    if len(a) <= 4 * len(lists):
        return np.array([len(np.intersect1d(lists[i], lists[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    # as products of 0/1 matrices over the values that two lists or more have
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, column, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = often[column.reshape(-1)] > 1
    names, column = np.unique(column.reshape(-1)[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[shared][order], column[order]
    top, total = int(a.max()) + 1, np.zeros(len(a), np.int64)
    for at in range(0, len(names), 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((len(lists), min(2048, len(names) - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += (part[:top] @ part.T)[a, b].astype(np.int64)
    return total


def described(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(id, h1, h2, size, keys) of each row with an id and a word: the hash of its shingle set and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids, sums, sizes, keys = [], [], [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t"), strict=True):
                found = shingles(words.of(t.as_py().split()), n)
                if len(found):
                    ids.append(i)
                    sums.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sizes.append(len(found))
                    keys.append(band_keys(minhash(found)).tobytes())
            both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "h1": pa.array(both[:, 0]), "h2": pa.array(both[:, 1]), "size": pa.array(sizes, pa.int32()), "keys": pa.array(keys, pa.binary())})

    i, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    rows = docs.where(i.isNotNull() & t.isNotNull()).select(i.cast("long").alias("id"), t.cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, h1 long, h2 long, size int, keys binary")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(id, root) of the representatives that share a band key with another, straight or through others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "id": pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))})

    banded = classes.select("rep", "keys").mapInArrow(run, "key long, id long")
    met = banded.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    met = met.select("key", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    edges = banded.withColumn("s", F.pmod(F.hash("id"), F.lit(SALTS))).join(met.hint("merge"), ["key", "s"]).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    return components(edges, name="groups")


class Member(NamedTuple):
    """A text of a unit: its bits for the base's shingles, and the shingles that the base lacks."""

    rep: int
    block: int
    copies: int
    size: int
    signature: np.ndarray
    bits: np.ndarray
    more: np.ndarray


def relative(found: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set as bits over a sorted base, in bytes, and what the base lacks."""
    at = np.minimum(np.searchsorted(base, found), len(base) - 1)
    there = base[at] == found
    bits = np.zeros(len(base), bool)
    bits[at[there]] = True
    return np.packbits(bits), found[~there]


def unit_results(rows: list[Member], i: int, j: int, fewest: np.ndarray, threshold: float) -> list[tuple]:
    """rows of the unit of blocks i and j.  Gives (rep, linked texts, linked documents, parent)."""
    rows = list({(r.rep, r.bits.tobytes(), r.more.tobytes()): r for r in rows}.values())
    block, reps, sizes, copies = (np.array([r[k] for r in rows]) for k in (1, 0, 3, 2))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return []
    signatures, more = np.stack([r.signature for r in rows]), [r.more for r in rows]
    bits = np.stack([np.pad(r.bits, (0, -len(r.bits) % 8)) for r in rows]).view(np.uint64)
    texts, linked, top = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
    for at in range(0, len(left), AT_ONCE):
        some = left[at : at + AT_ONCE]
        a, b = np.repeat(some, len(right)), np.tile(right, len(some))
        near = (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9) & (reps[a] != reps[b])
        near &= (a < b) if i == j else True
        a, b = pruned(a[near], b[near], signatures, fewest)
        if not len(a):
            continue
        inter = np.zeros(len(a), np.int64)
        for word in bits.T:
            inter += np.bitwise_count(word[a] & word[b])
        # only pairs that the rest of their sets can still bring over the threshold are looked up
        need = threshold * (sizes[a] + sizes[b]) / (1 + threshold) - 1e-9
        rest = np.array([len(x) for x in more])
        open_ = np.flatnonzero((inter < need) & (inter + np.minimum(rest[a], rest[b]) >= need))
        if len(open_):
            inter[open_] += common(a[open_], b[open_], more)
        true = inter >= need
        a, b = a[true], b[true]
        texts += np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        linked += (np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))).astype(np.int64)
        while len(apart := np.flatnonzero(top[a] != top[b])):
            a, b = a[apart], b[apart]
            x, y = top[a], top[b]
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top != top[top]).any():
                top = top[top]
    return [(rows[k].rep, int(texts[k]), int(linked[k]), rows[top[k]].rep) for k in np.flatnonzero(texts)]


def compared(docs: DataFrame, members: DataFrame, id_col: str, text: str, n: int, threshold: float, tolerance: float) -> DataFrame:
    """(rep, texts, docs, parent) from each unit.  members: (id, h1, h2, copies, root, block, blocks)."""
    fewest = least_matches(threshold, tolerance)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("t"))
    texts = rows.join(members.hint("shuffle_hash"), "id")
    own = ["id", "h1", "h2", "copies", "root", "block", "blocks"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            keep, found, size = [], [], 0
            part = batch.select(own)

            def taken(part=part) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*part.take(pa.array(keep, pa.int64())).columns, pa.array(found, pa.binary())], names=[*own, "found"])

            for k, (t, h1, h2) in enumerate(zip(batch.column("t"), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
                x = shingles(words.of((t.as_py() or b"").split()), n)
                if len(x) and tuple(np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)) == (h1, h2):
                    keep.append(k)
                    found.append(x.tobytes())
                    size += len(found[-1])
                if size > 16 << 20:
                    yield taken()
                    keep, found, size = [], [], 0
            yield taken()

    kinds = "id long, h1 long, h2 long, copies long, root long, block int, blocks int, found binary"
    here = F.array(F.struct(F.lit(1).alias("kind"), F.col("block").alias("at")))
    # the base goes to each block, before its texts
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.lit(0).alias("kind"), k.alias("at")))
    placed = texts.select(*own, "t").mapInArrow(sets, kinds).select("*", F.explode(F.when(F.col("id") == F.col("root"), F.concat(every, here)).otherwise(here)).alias("p"))
    placed = placed.select("root", F.col("p.at").alias("block"), F.col("p.kind").alias("kind"), "h1", "h2", "id", "copies", "blocks", "found")
    short = "root long, block int, blocks int, id long, copies long, size int, signature binary, bits binary, more binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, base = None, np.empty(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("root", "block", "kind", "blocks", "id", "copies")]
            for root, block, kind, blocks, rep, copies, found in zip(*columns, batch.column("found"), strict=True):
                x = np.frombuffer(found.as_py(), np.uint64)
                if of != (root, block):
                    of, base = (root, block), x
                if kind:
                    bits, more = relative(x, base)
                    out.append((root, block, blocks, rep, copies, len(x), minhash(x).astype(np.uint8).tobytes(), bits.tobytes(), more.tobytes()))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in short.split(", ")])

    order = ("root", "block", "kind", "h1", "h2")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.repartition("root", "block").sortWithinPartitions(*order).mapInArrow(encoded, short).select("*", other.alias("o"))
    dealt = dealt.select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "block", "copies", "size", "signature", "bits", "more")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(unit: tuple[int, int, int], held: list[Member]) -> pa.RecordBatch:
            got = unit_results(held, *unit[1:], fewest, threshold)
            return pa.RecordBatch.from_pydict({name: pa.array([x[k] for x in got], pa.int64()) for k, name in enumerate(("rep", "texts", "docs", "parent"))})

        unit, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "id", "block", "copies", "size", "signature", "bits", "more")]
            for root, i, j, rep, block, copies, size, signature, bits, more in zip(*columns, strict=True):
                if unit != (root, i, j) and held:
                    yield results(unit, held)
                    held = []
                unit = (root, i, j)
                held.append(Member(rep, block, copies, size, np.frombuffer(signature, np.uint8), np.frombuffer(bits, np.uint8), np.frombuffer(more, np.uint64)))
        if held:
            yield results(unit, held)

    grouped = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return grouped.mapInArrow(units, "rep long, texts long, docs long, parent long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row for each row of docs:

    doc_id; class_id, the smallest id that links lead to; copy_of, the smallest id with the same shingle set; n_copies, the
    rows with that set; n_linked_texts, the other sets within the threshold; n_links, the other rows within it, copies
    included.
    """
    seen = written(described(docs, id_col, text, n), "described")
    classes = seen.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = written(classes, "classes")
    groups = candidate_groups(classes)
    # an id that represents several sets has a row for each
    met = written(classes.select(F.col("rep").alias("id"), "h1", "h2", "copies", "size").join(groups.hint("shuffle_hash"), "id"), "members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum(F.col("size").cast("long")) / BLOCK_BYTES)).cast("int")
    sizes = met.groupBy("root").agg(blocks.alias("blocks"))
    sizes = sizes.select("root", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    placed = met.withColumn("s", F.pmod(F.hash("id", "h1"), F.lit(SALTS))).join(sizes.hint("shuffle_hash"), ["root", "s"])
    members = placed.select("id", "h1", "h2", "copies", "root", "blocks", F.pmod(F.xxhash64("id", "h1", "h2"), F.col("blocks").cast("long")).cast("int").alias("block"))
    links = written(compared(docs, members, id_col, text, n, threshold, tolerance), "links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("parent").alias("b")), name="classes")
    counts = links.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    linked = counts.join(roots.hint("merge"), counts.rep == roots.id, "left").select("rep", "texts", "docs", F.coalesce("root", "rep").alias("root"))
    # only sets with copies or links need a row here; every other document stands for itself
    known = classes.select("h1", "h2", "rep", "copies").join(linked.hint("shuffle_hash"), "rep", "left").where("copies > 1 or docs is not null")
    known = known.select("h1", "h2", F.col("rep").alias("of"), "copies", "texts", "docs", F.coalesce("root", "rep").alias("root"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    mine = seen.select("id", "h1", "h2", F.pmod(F.hash("id"), F.lit(SALTS)).alias("s")).join(known.hint("shuffle_hash"), ["h1", "h2", "s"], "left")
    copies = F.coalesce("copies", F.lit(1))
    rows = mine.select(
        F.col("id").alias("doc_id"),
        F.coalesce("root", "id").alias("class_id"),
        F.coalesce("of", "id").alias("copy_of"),
        copies.cast("long").alias("n_copies"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        (F.coalesce("docs", F.lit(0)) + copies - 1).cast("long").alias("n_links"),
    )
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`")
    wordless = docs.where(i.isNull() | t.isNull() | ~t.rlike(r"[^\x20\x09-\x0D]"))
    alone = wordless.select(i.alias("doc_id"), i.alias("class_id"), i.alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_linked_texts"), F.lit(0).cast("long").alias("n_links"))
    return rows.unionByName(alone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without those that follow another of their class: the one with the smallest id stays.  Of rows that
    repeat its id with the same text one stays."""
    found = near_duplicates(docs, id_col, text, **options)
    found = written(found.where("class_id is not null and (class_id <> doc_id or n_copies > 1)").select("doc_id", "class_id"), "found")
    gone = found.where("class_id <> doc_id").select(F.col("doc_id").alias("key")).distinct()
    taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"))
    kept = taken.join(gone.hint("shuffle_hash"), "key", "left_anti")
    again = found.where("class_id = doc_id").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    again = written(again, "again")
    if not again.isEmpty():  # ids are given twice or more, so some of their rows may be equal
        twice = kept.join(again.hint("shuffle_hash"), "key", "left_semi").withColumn("same", F.xxhash64(F.col("row").getField(text)))
        first = twice.groupBy("key", "same", F.col("row").getField(text).alias("t")).agg(F.first("row").alias("row"))
        kept = kept.join(again.hint("shuffle_hash"), "key", "left_anti").select("row").unionByName(first.select("row"))
    return kept.select("row.*")
