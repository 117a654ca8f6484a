"""The corpus pipeline: documents that pass quality rules, one of each group of near copies, none with benchmark passages,
personal data replaced, as piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of documents.

Defined cases, for each stage as its operator has them: a null or empty text fails the first stage's rule of length, so it
goes there; very long texts are taken whole; rows with a null id are judged by their text, and stay at near_duplicates; rows
that repeat an id with one text become one row there, those with different texts stay; of texts that tie the smallest id
stays; an empty table gives an empty table; more columns travel along, whatever their names, but that sentencepiece puts its
``ids`` and ``intact`` in the place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, ngram_join, pii, quality, spm
from weftline.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go.  A null text has no words and goes; repeated rows are judged one by one."""
    return quality.filtered(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id stays.
    Rows without an id, and texts without words, are like no other and stay."""
    return ngram_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go.  A null text or item leaks
    nowhere."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars follows.  A null text stays null."""
    return pii.redacted(docs, length="n_chars" if "n_chars" in docs.columns else None)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether these decode to the text; both null for a null text."""
    return spm.encode(docs, checked=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Neither the pieces' lattice nor edit distance to passages can be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
