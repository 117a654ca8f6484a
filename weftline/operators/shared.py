"""Folders that all executors share, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests, local mode) a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _own[0]


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of our own in the shared one, which goes when the session's driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, fs = _located(spark, folder)
    fs.mkdirs(path)  # only what is there is deleted on exit
    fs.deleteOnExit(path)
    return folder


def _located(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that written() gave and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, fs = _located(df.sparkSession, folder)
        fs.delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs a read and no recomputation."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in (*taken, *out)}:
            name = "_" + name
        out.append(name)
    return out


def in_order(df: DataFrame, order: list[str], number: str, total: dict[str, str] | None = None) -> DataFrame:
    """df with the number of each row (from 0) in an order of all rows, and running totals of columns (new name: column).

    Rows are dealt into ranges of the order and written with their places; what comes before a range is added from one row for
    each range.  So no task sorts all rows, also where one value of the first column has most of them, as long as the others
    tell rows apart.
    """
    total = total or {}
    part, before, *sums = unused([*df.columns, number, *total], "_part", "_before", *[f"_before_{k}" for k in range(len(total))])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within a task, in the order of its rows
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias(part), place.alias(number)), "ranges")
    ends = dealt.groupBy(part).agg(F.count("*").alias(before), *[F.sum(c).alias(s) for s, c in zip(sums, total.values(), strict=True)])
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ends.select(part, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in (before, *sums)])
    met = dealt.join(F.broadcast(offsets), part)
    running = Window.partitionBy(part).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    summed = met.withColumns({name: F.sum(c).over(running) + F.col(s) for s, (name, c) in zip(sums, total.items(), strict=True)})
    return summed.withColumn(number, F.col(number) + F.col(before)).drop(part, before, *sums)
