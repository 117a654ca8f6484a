"""Language identification by compression.

One zstandard dictionary of raw content stands for each language.  A text is encoded once with every dictionary, in lower case, and the
language whose dictionary gives the smallest result wins.  The margin to the second smallest is the score; a text whose
margin is narrow is marked as rejected (``confident`` is false), while its best guess stays in ``lang_pred``.

Learning reads a bounded sample, documented by the parameters of ``learn``: of each language up to ``docs_per_lang`` labelled
texts, as far as they fill a dictionary of ``dict_chars`` characters (the text at that limit is cut there), and smaller
dictionaries where there are so many languages that all would pass ``max_chars``.  Every label is learned, whatever their number, from LEAST_CHARS characters at
least.  Predicting reads every text whole, with LOADED dictionaries in memory at once; its time grows with the texts times the
languages.

Defined cases: a null text, and one without any letter, gets ``und`` with score 0.  With no learned language (an empty table
too) everything is ``und``.  Ties go to the language that sorts first.  Rows with a null language teach nothing.  Repeated
rows and null ids are predicted like any other row; only ``text`` is an input of a prediction.  Very long texts are compressed
whole.  Kept columns that are named like a new one give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.shared import written

LOADED = 64
LEAST_CHARS = 64
LETTER = regex.compile(r"\p{L}")


def settings() -> zstandard.ZstdCompressionParameters:
    """Short matches, as languages differ in pieces of words; made in each task."""
    return zstandard.ZstdCompressionParameters.from_level(6, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 96, dict_chars: int = 98_304, max_chars: int = 25_165_824) -> dict[str, bytes]:
    """Raw dictionary content by language.

    The sample is the docs_per_lang different texts of each language with the smallest hashes, so it depends on the rows
    alone and on no order; a dictionary takes them until it is full, and the last one only so far.  At most max_chars characters (256 full
    dictionaries), or LEAST_CHARS for each language if that is more, reach the driver.
    """
    t, of = F.col(f"`{text}`"), F.col(f"`{lang}`")
    given = labelled.where(t.isNotNull() & of.isNotNull() & t.rlike(r"\p{L}")).select(of.alias("lang"), t.alias("whole"), F.xxhash64(t).alias("h"))
    # the rank limit is pushed below the shuffle, so a language that has most of the rows sends a few from each task
    ranked = given.withColumn("k", F.dense_rank().over(Window.partitionBy("lang").orderBy("h", "whole"))).where(F.col("k") <= docs_per_lang)
    sample = written(ranked.groupBy("lang", "k").agg(F.first("whole").alias("whole")), "sample")
    each = max(LEAST_CHARS, min(dict_chars, max_chars // max(1, sample.where("k = 1").count())))
    before = F.coalesce(F.sum(F.length("whole") + 1).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = sample.withColumn("before", before).where(F.col("before") < each)
    rows = filled.select("lang", "k", F.expr(f"substring(whole, 1, cast({each} - before as int))").alias("part")).collect()
    parts_of: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.k)):
        parts_of.setdefault(r.lang, []).append(r.part.lower())
    return {x: "\n".join(found).encode() for x, found in parts_of.items()}


def loaded(dictionaries: list[tuple[str, bytes]]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    coders = []
    for lang, data in dictionaries:
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=settings())
        coders.append((lang, zstandard.ZstdCompressor(dict_data=raw, compression_params=settings())))
    return coders


def smallest(text: str | None, coders: list[tuple[str, zstandard.ZstdCompressor]], held: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The two smallest sizes, with their languages, of those held and of the text by these coders."""
    if text is None or not LETTER.search(text):
        return []
    data = text.lower().encode("utf-8", "replace")
    return sorted(held + [(len(c.compress(data)), lang) for lang, c in coders])[:2]


def judged(sizes: list[tuple[int, str]]) -> tuple[str, float]:
    """The best language and its margin as a share of the second smallest size."""
    if not sizes:
        return "und", 0.0
    return sizes[0][1], (1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str | Column] | None = None, min_margin: float = 0.02) -> DataFrame:
    """The kept columns (all by default) with lang_pred, score (the margin, 0 to 1) and confident (margin at least
    min_margin).  A narrow pass: Spark hands Arrow batches to each task, and nothing is shuffled."""
    content = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by the parameters of learn()
    kept = keep or [F.col(f"`{c}`") for c in docs.columns]
    names = [c for c in docs.select(*kept).columns if c not in ("lang_pred", "score", "confident")]
    source = docs.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted(content.value.items())
        blocks = [known[at : at + LOADED] for at in range(0, len(known), LOADED)]
        fixed = loaded(blocks[0]) if len(blocks) == 1 else None
        for batch in batches:
            sizes: list[list[tuple[int, str]]] = [[] for _ in range(batch.num_rows)]
            for block in blocks:
                coders = fixed or loaded(block)
                sizes = [smallest(t.as_py(), coders, held) for t, held in zip(batch.column("text"), sizes, strict=True)]
            found = [judged(x) for x in sizes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[1] >= min_margin for x in found], pa.bool_())],
                names=["row", "lang_pred", "score", "confident"],
            )

    out = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, lang_pred string, score double, confident boolean")
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "lang_pred", "score", "confident")
