"""Counts of words over a corpus, and the frequent ones within a bound that is checked before they reach the driver."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000


def counted(docs: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(word, n): how often each word occurs in the rows of docs, columns t (UTF-8) and weight (0 or 1); a word of rows with
    weight 0 is there with what it has elsewhere.  Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t, weight in zip(batch.column("t"), batch.column("weight").to_pylist(), strict=True):
                words = split(t.as_py() or b"")
                if weight:
                    seen.update(words)
                else:
                    for w in words:
                        seen.setdefault(w, 0)
                if len(seen) > FLUSH:
                    yield flushed()
        yield flushed()

    return docs.select("t", "weight").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, most: int, longest: int = 64) -> DataFrame:
    """The rows of words (word, n, ...) with the greatest n: all with at least a number that leaves at most ``most`` rows, none
    longer than ``longest`` bytes.  So they fit in most * longest bytes, whatever the corpus."""
    levels = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8).cast("int")
    short = words.where((F.octet_length("word") <= longest) & (F.col("n") > 0)).withColumn("level", levels)
    found = sorted(((r.level, r.k) for r in short.groupBy("level").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for level, k in found:  # a few hundred levels at most
        total += k
        if total > most:
            break
        least = level
    return short.where(F.col("level") >= least).drop("level")
