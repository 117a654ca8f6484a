"""Small column helpers, and what operators share of folders and written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.shared import discard, new_dir, shared_dir, written  # noqa: F401

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of(column: str) -> Column:
    """crc32 of a number written as text; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside interpreted lambda functions."""
    return F.transform(F.array(value), body)[0]
