"""Histograms of one and two columns, of equal width or of equal weight, and column ranges.

Equal width: bin i is [begin + i * stride, begin + (i + 1) * stride); there are 1 + floor((end - begin) / stride) bins, empty
ones included.  Equal weight: rows are numbered in the order of a column and of what breaks its ties, range by range, so that
exact bins need no sort of all rows in one task.  With ``error`` bins come from mergeable quantile sketches instead: one aggregate
over the rows, no exchange of rows by range; a border's rank is off by that share of all rows at most, and equal values are never
parted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.shared import in_order, unused


def n_bins(begin: float, end: float, stride: float) -> int:
    return 1 + math.floor((end - begin) / stride)


def place(column: str, begin: float, stride: float) -> Column:
    return F.floor((F.col(column) - F.lit(begin)) / F.lit(stride))


def uniform_1d(df: DataFrame, column: str, begin: float, end: float, stride: float) -> DataFrame:
    """(bin, bound, n), every bin of the range."""
    size = n_bins(begin, end, stride)
    counts = df.where(F.col(column).isNotNull()).groupBy(place(column, begin, stride).alias("bin")).agg(F.count("*").alias("k")).where(f"bin >= 0 and bin < {size}")
    return df.sparkSession.range(size).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", (F.lit(float(begin)) + F.col("bin") * F.lit(float(stride))).alias("bound"), F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def uniform_2d(df: DataFrame, x: str, y: str, bx: float, ex: float, sx: float, by: float, ey: float, sy: float) -> DataFrame:
    """(bin1, bin2, bound1, bound2, n), every cell of the range, row by row."""
    nx, ny = n_bins(bx, ex, sx), n_bins(by, ey, sy)
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(place(x, bx, sx).alias("bin1"), place(y, by, sy).alias("bin2")).agg(F.count("*").alias("k"))
    cells = df.sparkSession.range(nx * ny).select(F.expr(f"id div {ny}").alias("bin1"), (F.col("id") % ny).alias("bin2"))
    return cells.join(counts, ["bin1", "bin2"], "left").select(
        "bin1", "bin2", (F.lit(float(bx)) + F.col("bin1") * F.lit(float(sx))).alias("bound1"), (F.lit(float(by)) + F.col("bin2") * F.lit(float(sy))).alias("bound2"), F.coalesce("k", F.lit(0)).cast("long").alias("n")
    )


def with_ntile(df: DataFrame, column: str, bins: int, ties: list[str] | None = None, name: str = "bin") -> DataFrame:
    """df with the bin (from 1) that ntile over all rows in the order of column and ties would give."""
    [rank] = unused([*df.columns, name], "_rank")
    placed = in_order(df, [column, *(ties or [])], rank)
    share, more = divmod(df.count(), bins)
    wide = more * (share + 1)
    place = F.when(F.col(rank) < wide, F.expr(f"{rank} div {share + 1}") + 1).otherwise(F.expr(f"({rank} - {wide}) div {max(1, share)}") + more + 1)
    return placed.withColumn(name, place.cast("long")).drop(rank)


def sketched_bins(df: DataFrame, columns: dict[str, int], error: float) -> list[Column]:
    """The bin (from 1) of each column, {column: number of bins}, all from one aggregate: one more than the borders below a value,
    so where many rows tie bins are left out.  A border's rank is within error * rows of an even share."""
    accuracy = math.ceil(1 / error)
    asked = [F.percentile_approx(c, [k / n for k in range(1, n)], accuracy) if n > 1 else F.lit(None) for c, n in columns.items()]
    found = df.agg(*[a.alias(f"q{k}") for k, a in enumerate(asked)]).first()
    bins = []
    for (c, _), borders in zip(columns.items(), found, strict=True):
        bins.append(sum(((F.col(c) > F.lit(x)).cast("long") for x in borders or []), F.lit(1).cast("long")))
    return bins


def adaptive_1d(df: DataFrame, column: str, bins: int = 25, ties: list[str] | None = None, error: float | None = None) -> DataFrame:
    """(bin, lower, n) of equal weight."""
    if error:
        real = df.where(F.col(column).isNotNull())
        return real.groupBy(sketched_bins(real, {column: bins}, error)[0].alias("bin")).agg(F.min(column).alias("lower"), F.count("*").alias("n"))
    placed = with_ntile(df.where(F.col(column).isNotNull()), column, bins, ties)
    return placed.groupBy("bin").agg(F.min(column).alias("lower"), F.count("*").alias("n"))


def adaptive_2d(df: DataFrame, x: str, y: str, nx: int = 25, ny: int = 25, ties: list[str] | None = None, error: float | None = None) -> DataFrame:
    """(bin1, bin2, lower1, upper1, lower2, upper2, n): both columns in bins of equal weight, non-empty cells."""
    real = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([x, y, *(ties or [])]))
    if error:
        one, two = sketched_bins(real, {x: nx}, error) + sketched_bins(real, {y: ny}, error) if x == y else sketched_bins(real, {x: nx, y: ny}, error)
        placed = real.withColumns({"bin1": one, "bin2": two})
    else:
        placed = with_ntile(with_ntile(real, x, nx, ties, "bin1"), y, ny, ties, "bin2")
    cells = placed.groupBy("bin1", "bin2").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}{k}") for k, c in ((1, x), (2, y)) for f in (F.min, F.max)])
    side = lambda k: cells.groupBy(f"bin{k}").agg(F.min(f"min{k}").alias(f"lower{k}"), F.max(f"max{k}").alias(f"upper{k}"))
    return cells.select("bin1", "bin2", "n").join(side(1), "bin1").join(side(2), "bin2").select("bin1", "bin2", "lower1", "upper1", "lower2", "upper2", "n")


def scatter(df: DataFrame, x: str, y: str, nx: int = 25, ny: int = 25, bx: float | None = None, ex: float | None = None, by: float | None = None, ey: float | None = None) -> DataFrame:
    """(center1, center2, n) of the non-empty cells, fewest first.  Ends that are not given come from the data; a stride is a
    little above an even share, so that the greatest value falls into the last bin."""
    low = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    bx, ex, by, ey = (given if given is not None else float(seen) for given, seen in zip((bx, ex, by, ey), low, strict=True))
    sx, sy = math.nextafter((ex - bx) / nx, math.inf), math.nextafter((ey - by) / ny, math.inf)
    inside = F.col(x).between(bx, ex) & F.col(y).between(by, ey)
    cells = df.where(inside).groupBy(place(x, bx, sx).alias("i"), place(y, by, sy).alias("j")).agg(F.count("*").alias("n"))
    return cells.select((F.lit(bx) + (F.col("i") + 0.5) * F.lit(sx)).alias("center1"), (F.lit(by) + (F.col("j") + 0.5) * F.lit(sy)).alias("center2"), "n").orderBy("n", "center1", "center2")


def column_ranges(df: DataFrame) -> DataFrame:
    """(name, least, greatest) of every numeric column: one aggregate, then one row for each column.  Zero has no sign."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    one = df.agg(*[(F.min(c).cast("double") + F.lit(0.0)).alias(f"lo{k}") for k, c in enumerate(names)], *[(F.max(c).cast("double") + F.lit(0.0)).alias(f"hi{k}") for k, c in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"lo{k}").alias("least"), F.col(f"hi{k}").alias("greatest")) for k, c in enumerate(names)])).alias("r")).select("r.*")


def frequencies(df: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, n); with wanted keys, 0 for those that never occur."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts if wanted is None else wanted.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
