"""Subword lattice likelihood: the probability of a text summed over all its segmentations into pieces.

The vocabulary is that of a public tokenizer, and its scores give the first weights (they are ranks, so Zipf's law: a piece of
rank r has a weight of 1 / (r + 2)).  One round of expectation maximisation over the words of the training texts, with these
weights as a prior, gives the unigram probabilities of pieces, bytes and the end of a text.  A text's score is the log10 of
its marginal probability, from the forward recursion in log space.

No piece but a first one reaches over white space, so the recursion runs over words, and each different word of the corpus is
computed once.  Beside it runs a base score: word unigrams with add-one smoothing.

Frequent words are looked up where the texts are, from a table of bounded size; the others are joined by word.  What is
counted and joined grows with the corpus.

Defined cases: a null text counts as empty, which has its end as the only token.  With no training text every word is unknown
and the prior alone weights the pieces.  Repeated rows are each scored and each counted; a null in the fold column trains.  Very
long texts are scored whole, and very long words in time that grows with their length.  An empty table gives no rows.  Words
that tie in frequency are looked up or joined with the same result.  Kept columns that are named like a new one give way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import pieces as table
from weftline.llm.frequent import counted, most_frequent
from weftline.llm.shared import written

#: Words that tasks hold; 64 bytes each at most.
FREQUENT = 200_000
#: The prior counts for so many pieces; the share of it that bytes have.
PRIOR, BYTE_SHARE = 32_000.0, 1e-4
LN10 = float(np.log(10))
ROW = "rid long, word binary, n long, n_tokens long, n_known long, base double, score double"


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


def prior(model: table.Pieces) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces and the prior probabilities of pieces and bytes."""
    names = list(model.ids)
    rank = np.array([-model.ids[p][1] for p in names])
    weight = 1.0 / (np.minimum(np.maximum(rank, 0), 1e6) + 2.0)
    return names, weight / weight.sum() * (1 - BYTE_SHARE), np.full(256, BYTE_SHARE / 256)


def trained(counts: DataFrame, model: table.Pieces, n_docs: int) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Pieces, natural log probabilities of pieces and bytes, and of the end.  counts: (word, n).

    The expectations of a task are one number for each piece; their sums (as many rows as the vocabulary) reach the driver.
    """
    names, p, b = prior(model)
    sent = counts.sparkSession.sparkContext.broadcast((names, np.log(p), np.log(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = table.Lattice(*sent.value), np.zeros(len(names) + 256)
        for batch in batches:
            words = [table.MARK + w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            total += np.concatenate(lattice.expected(words, batch.column("n").to_numpy().astype(float)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.float64())], names=["k", "x"])

    sums = np.zeros(len(names) + 256)
    for r in counts.where("n > 0").select("word", "n").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        sums[r.k] = r.x
    sums += PRIOR * np.concatenate([p, b])
    logs = np.log(sums / (sums.sum() + n_docs + 1))
    return names, logs[: len(names)], logs[len(names) :], float(np.log((n_docs + 1) / (sums.sum() + n_docs + 1)))


def lexicon(counts: DataFrame, parts: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(word, n, score): the log10 marginal probability of each different word."""
    sent = counts.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = table.Lattice(*sent.value)
        for batch in batches:
            words = [table.MARK + w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(lattice.log_probability(words) / LN10)], names=["word", "n", "score"])

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, score double")


def scored(docs: DataFrame, held_out: Column, text: str = "text", keep: list[str] | None = None, model_path: str = table.DEFAULT_MODEL) -> DataFrame:
    """The kept columns of every row with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark, model = docs.sparkSession, table.load(model_path)
    held = F.coalesce(held_out, F.lit(False))
    new = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in keep or docs.columns if c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in names], held.alias("held_out"))
    rows = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"), (~held).cast("int").alias("weight"))
    counts = written(counted(rows, split), "counts")
    n_docs = rows.agg(F.sum("weight")).first()[0] or 0
    n_words, n_types = counts.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    n_tokens, n_types = (n_words or 0) + n_docs, n_types + (n_docs > 0)
    *parts, log_end = trained(counts, model, n_docs)
    words = written(lexicon(counts, tuple(parts)), "lexicon")
    below = np.log10(n_tokens + n_types + 1)
    often = most_frequent(words, FREQUENT).toArrow()
    known = often.column("n").to_numpy()
    sent = spark.sparkContext.broadcast((often.column("word").to_pylist(), known, np.log10(known + 1.0) - below, often.column("score").to_numpy()))
    end = (int(n_docs > 0), float(np.log10(n_docs + 1.0) - below), log_end / LN10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(sent.value[0])}
        seen, base, score = sent.value[1] > 0, sent.value[2], sent.value[3]
        for batch in batches:
            out: list[tuple] = []
            for at, (rid, t) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("t"), strict=True)):
                parts = split(t.as_py())
                here: list[int] = []
                times: list[int] = []
                for w, n in Counter(parts).items():
                    k = place.get(w)
                    if k is None:
                        out.append((None, rid, w, n, 0, 0, 0.0, 0.0))
                    else:
                        here.append(k)
                        times.append(n)
                k, n = np.array(here, np.int64), np.array(times, np.int64)
                out.append((at, rid, None, 0, len(parts) + 1, int(n[seen[k]].sum()) + end[0], float(base[k] @ n) + end[1], float(score[k] @ n) + end[2]))
                if len(out) > 100_000:
                    yield _arrow(batch, out)
                    out = []
            yield _arrow(batch, out)

    def _arrow(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        """A row of the batch for each text, and null for its words."""
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.float64(), pa.float64()]
        at, *columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("row").take(at), *columns], names=["row", *[x.split()[0] for x in ROW.split(", ")]])

    # numbers of rows hold only within one table, so the rows are written with them once
    numbered = written(rows.select(F.monotonically_increasing_id().alias("rid"), "row", "t").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {ROW}"), "scores")
    rare = numbered.where("word is not null").select("rid", "word", F.col("n").alias("times"))
    found = rare.join(words, "word").select(
        "rid",
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"),
        ((F.log10(F.col("n") + 1.0) - F.lit(float(below))) * F.col("times")).alias("base"),
        (F.col("score") * F.col("times")).alias("score"),
    )
    extra = found.groupBy("rid").agg(F.sum("n_known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    heads = numbered.where("word is null").join(extra, "rid", "left")
    return heads.select(
        *[F.col("row").getField(c).alias(c) for c in (*names, "held_out")],
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )

