"""Ranked lexical search over sketches of documents.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased.  A term's
impact on a document's score grows with its occurrences there, so the greatest occurrence of all terms that fall on a
coordinate bounds the impact of each of them.

1. ``index`` folds each document once into a hashed max-sketch: every term stands at two coordinates, each coordinate holds the
   greatest occurrence that fell on it (255 stands for any number from there on), and a sketch has SLOTS to 2 * SLOTS
   coordinates for each different term.  The document's terms and occurrences stay beside the sketch, as hashes, in a table of
   the shared folder; bounds read the sketch, scores read the terms.
2. ``search`` looks up all terms of a block of queries in the sketches of many documents at once.  The lesser of a term's two
   coordinates bounds its occurrences, and the sum of the impacts bounds the document's score for a query.
3. Each task goes through its documents by descending bound and scores them exactly, until the bound falls below the least of
   the best ``k`` that it has; it keeps k rows for each query, whatever its share of the documents.  Spark ranks what the tasks
   keep, again k rows for each query and task at most before the shuffle.

Weights need the number of documents with each term of the queries: one pass over the index, counted in tasks.  Queries are the
side that tasks hold; above ``block_bytes`` of their text they are searched in blocks.  Scores are 64-bit integers throughout
and bounds are sums of integers below 2^53, so no rounding can drop a document.  Terms are told apart by 64-bit hashes: two
terms of a query block and the corpus that share one would count as the same, which a vocabulary of a thousand million terms
and ten thousand query terms meet with a chance of one in a million.

Defined cases: a null, empty or termless text is no document for the counts and is never found; a null or termless query
finds nothing; a repeated query is ranked by itself, also where its id repeats; of equal scores the smaller id comes first, and
rows without an id last; rows that repeat an id are ranked one by one; very long texts are folded whole, into a sketch in
proportion; an empty table on either side gives no rows.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.shared import written
from weftline.llm.words import WordHashes

#: Coordinates for each different term, at least; the greatest occurrence that a coordinate tells apart.
SLOTS, FULL = 8, 255
#: Documents, and bytes of sketches, that are looked up at a time.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20
INDEX = "doc_id long, n long, sketch binary, terms binary, tfs binary"
FOUND = "item int, item_id long, doc_id long, score long"

#: Bytes as terms see them: A-Z in lower case, all other ASCII but letters and digits as a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(FOLD).split() if text else []


def _width(n_terms: int) -> int:
    return 1 << max(6, (SLOTS * n_terms - 1).bit_length())


def _places(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two coordinates of each term in a sketch of that width, a power of two."""
    mask = np.uint64(width - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def sketched(text: bytes | None, hashes: WordHashes) -> tuple[int, bytes, bytes, bytes]:
    """(number of terms, sketch, hashes of the different terms in order, their occurrences)."""
    counts = Counter(terms_of(text))
    own, tfs = hashes.of(list(counts)), np.fromiter(counts.values(), np.uint32, len(counts))
    order = np.argsort(tfs, kind="stable")  # the greatest is set last and stays
    sketch, held = np.zeros(_width(len(own)), np.uint8), np.minimum(tfs[order], FULL).astype(np.uint8)
    one, two = _places(own[order], len(sketch))
    sketch[np.stack([one, two], 1).ravel()] = np.repeat(held, 2)
    by_hash = np.argsort(own)
    return int(tfs.sum()), sketch.tobytes(), own[by_hash].tobytes(), tfs[by_hash].tobytes()


def index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, sketch, terms, tfs) of every document with a term, as a table in the shared folder.  One narrow pass; its size
    is in proportion to the different terms of each text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                n, *parts = sketched(t.as_py(), hashes)
                if n:
                    out.append((doc_id, n, *parts))
                    size += sum(map(len, parts))
                if size > SLICE_BYTES:
                    yield _batch(out, INDEX)
                    out, size = [], 0
            yield _batch(out, INDEX)

    return written(rows.mapInArrow(run, INDEX), "lexical")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _blocks(queries: DataFrame, id_col: str, text: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The queries with terms, in blocks of about block_bytes of text."""
    rows = queries.select(F.col(f"`{id_col}`").cast("long").alias("q"), F.col(f"`{text}`").cast("binary").alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("q", "t"), F.lit(n)) == k)
        yield [(r.q, bytes(r.t)) for r in part.collect()]


def document_frequencies(indexed: DataFrame, asked: np.ndarray) -> np.ndarray:
    """How many documents hold each of the asked terms (sorted hashes).  Tasks count, and Spark sums one row for each term and
    task."""
    sent = indexed.sparkSession.sparkContext.broadcast(asked)  # the terms of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        seen = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for t in batch.column("terms"):
                own = np.frombuffer(t.as_py(), np.uint64)
                # the shorter list is looked up in the longer one
                if len(own) < len(wanted):
                    at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    seen[at[wanted[at] == own]] += 1
                else:
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    seen[own[at] == wanted] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["at", "n"])

    out = np.zeros(len(asked), np.int64)
    if len(asked):
        for r in indexed.select("terms").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
    return out


@dataclass(frozen=True)
class Block:
    """A block of queries as tasks hold it: ids, and the terms of all (sorted hashes) with their weights; each query's terms as
    positions among these, and each term's queries."""

    ids: list[int | None]
    terms: np.ndarray
    weights: np.ndarray
    own: list[np.ndarray]
    n_docs: int
    n_terms: int
    k: int

    def by_term(self) -> tuple[np.ndarray, np.ndarray]:
        """(begin of each term's queries, one more at the end; the queries)."""
        term = np.concatenate([*self.own, np.empty(0, np.int64)])
        query = np.repeat(np.arange(len(self.own)), [len(x) for x in self.own])
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.terms) + 1)), query[order]

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """What a document's length adds below the line of an impact."""
        return 50 + (50 * n * self.n_docs) // self.n_terms


def impacts(tfs: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


def bounds(block: Block, sketches: list[bytes], m: np.ndarray, begins: np.ndarray, of_term: np.ndarray) -> np.ndarray:
    """(documents x queries) upper bounds of scores, from sketches alone."""
    out, widths = np.zeros((len(sketches), len(block.ids))), np.fromiter(map(len, sketches), np.int64, len(sketches))
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        held = np.frombuffer(b"".join(sketches[r] for r in rows), np.uint8).reshape(len(rows), width)
        one, two = _places(block.terms, int(width))
        seen = np.minimum(held.take(one, 1), held.take(two, 1))
        doc, term = np.nonzero(seen)
        tfs = seen[doc, term].astype(np.int64)
        most = np.where(tfs == FULL, 1_000_000, impacts(tfs, m[rows[doc]])) * block.weights[term]
        # each impact goes to all queries with the term
        times = begins[term + 1] - begins[term]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begins[term], times)
        cell = np.repeat(doc, times) * len(block.ids) + of_term[at]
        out[rows] = np.bincount(cell, np.repeat(most, times), len(rows) * len(block.ids)).reshape(len(rows), -1)
    return out


def exact(block: Block, query: int, terms: np.ndarray, tfs: np.ndarray, m: int) -> int:
    """A document's score for a query, from its terms."""
    own = block.own[query]
    asked = block.terms[own]
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    there = terms[at] == asked
    return int((block.weights[own[there]] * impacts(tfs[at[there]].astype(np.int64), m)).sum())


class Best:
    """The best k of a query: highest score, then smallest id, rows without an id last."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def least(self) -> int:
        """A score below this cannot enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if score > 0:
            heapq.heappush(self.heap, entry) if len(self.heap) < self.k else heapq.heappushpop(self.heap, entry)

    def rows(self) -> Iterator[tuple[int | None, int]]:
        return ((-key if known else None, score) for score, known, key in self.heap)


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with so many rows and bytes of sketches at most, or one row."""
    ends = np.cumsum([len(x) for x in batch.column("sketch").to_pylist()])
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


def search(indexed: DataFrame, queries: DataFrame, k: int = 50, item_col: str = "item_id", text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query, from 1."""
    n_docs, n_terms = indexed.agg(F.count("*"), F.sum("n")).first()
    out = None
    for number, block_rows in enumerate(_blocks(queries, item_col, text, block_bytes)):
        hashes = WordHashes()
        per_item = [np.unique(hashes.of(terms_of(t))) for _, t in block_rows]
        asked = np.unique(np.concatenate([*per_item, np.empty(0, np.uint64)]))
        df = document_frequencies(indexed, asked)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        block = Block([q for q, _ in block_rows], asked, weights, [np.searchsorted(asked, x) for x in per_item], n_docs, n_terms or 1, k)
        ranked = _search_block(indexed, block).withColumn("block", F.lit(number))
        out = ranked if out is None else out.unionByName(ranked)
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(indexed: DataFrame, block: Block) -> DataFrame:
    """(item, item_id, doc_id, score): the best k of each query in each task."""
    sent = indexed.sparkSession.sparkContext.broadcast(block)  # about block_bytes of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        begins, of_term = own.by_term()
        best = [Best(own.k) for _ in own.ids]
        for batch in (part for whole in batches for part in _sliced(whole)):
            ids, m = batch.column("doc_id").to_pylist(), own.lengths(batch.column("n").to_numpy())
            upper = bounds(own, batch.column("sketch").to_pylist(), m, begins, of_term)
            terms, tfs = batch.column("terms"), batch.column("tfs")
            least = np.array([b.least() for b in best])
            for q in np.flatnonzero((upper >= least).any(0)):
                high, ranked = upper[:, q], best[q]
                rows = np.flatnonzero(high >= least[q])
                for r in rows[np.argsort(-high[rows], kind="stable")]:
                    if high[r] < ranked.least():
                        break
                    ranked.offer(exact(own, q, np.frombuffer(terms[r].as_py(), np.uint64), np.frombuffer(tfs[r].as_py(), np.uint32), int(m[r])), ids[r])
        for q, b in enumerate(best):
            if b.heap:
                yield _batch([(q, own.ids[q], doc_id, score) for doc_id, score in b.rows()], FOUND)

    return indexed.mapInArrow(run, FOUND)
