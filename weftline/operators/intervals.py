"""Overlap joins between interval tables.

Each row of A has a window around its interval, ``before`` to ``after``; it pairs with the rows of B of the same group whose
interval touches the window, both ends included.  A range condition alone would be a nested loop, so both sides are cut into
bins, of several widths: level 0 is ``bin_size`` wide, which should be near the usual window (``choose_bin_size`` takes it from the
data), and each level FANOUT times as wide as the one before.  An interval owns the level at which it touches a few bins.

A pair meets at the level of its longer interval, which owns it: in one equi-join where that is A's or both are of one level,
in another one where it is B's.  In each, the owners of a level stand against the other side's rows of that level or below, which touch
one bin there, or two.  So a long interval is set beside the rows under it and makes no other two rows meet, and rows go only to
levels that the other side owns.  A pair counts in the first bin that both have, so none comes twice.  A crowded bin is split
by Spark's handling of skewed joins.  Columns of a and b come with a prefix, so only names that begin with an underscore are
kept free.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FANOUT = 8
#: A table of so few rows may be one split of a file; its rows are dealt anew, as the join multiplies them in the tasks they are in.
SMALL = 1 << 22


@dataclass(frozen=True)
class Window:
    """Pads to the left and right of A; strand-aware windows swap them and mirror coordinates on the minus strand."""

    left: int = 1000
    right: int = 1000
    same_strand: bool = False
    stranded: bool = False
    bins: int = 0


def strand_side(strand: Column) -> Column:
    """'+' for 1 or '+' (also its code 43), and '-' for anything else, unknown strands included."""
    return F.when(strand.cast("string").isin("1", "+", "43"), "+").otherwise("-")


def _flipped(a_strand: str | None, window: Window) -> Column:
    # without equal strands a flip changes something only if the pads differ
    acts = window.stranded and a_strand and (window.same_strand or window.left != window.right)
    return (strand_side(F.col(a_strand)) == "-") if acts else F.lit(False)


def choose_bin_size(a: DataFrame, b: DataFrame, window: Window, quantile: float = 0.95, least: int = 16) -> int:
    """About the length that most windows and intervals stay under; two small aggregates."""
    wide = a.agg(F.percentile_approx(F.col("end") - F.col("start"), quantile)).first()[0] or 0
    long = b.agg(F.percentile_approx(F.col("end") - F.col("start"), quantile)).first()[0] or 0
    return int(max(least, wide + window.left + window.right, long))


def overlap_join(a: DataFrame, b: DataFrame, window: Window = Window(), group: str = "chr", strand: str | None = None, bin_size: int | None = None) -> DataFrame:
    """Pairs as (group, start, end, A__<column>…, B__<column>…), start and end relative to A.  a and b have start and end."""
    size = bin_size or choose_bin_size(a, b, window)
    named_a = a.select(*[F.col(f"`{c}`").alias(f"A__{c}") for c in a.columns])
    named_b = b.select(*[F.col(f"`{c}`").alias(f"B__{c}") for c in b.columns])
    flip = _flipped(f"A__{strand}" if strand else None, window)
    left, right = F.when(flip, F.lit(window.right)).otherwise(window.left), F.when(flip, F.lit(window.left)).otherwise(window.right)
    spread_a = named_a.withColumns({"_flip": flip, "_before": F.col("A__start").cast("long") - left, "_after": F.col("A__end").cast("long") + right})
    spread_b = named_b.withColumns({"_from": F.col("B__start").cast("long"), "_to": F.col("B__end").cast("long")})
    owned_a, owned_b = _owned(spread_a, "_before", "_after", size), _owned(spread_b, "_from", "_to", size)
    spread_a, spread_b = _dealt(spread_a, owned_a), _dealt(spread_b, owned_b)
    same = (strand_side(F.col(f"A__{strand}")) == strand_side(F.col(f"B__{strand}"))) if window.same_strand and strand else F.lit(True)

    def met(levels_a: dict[int, int] | None, levels_b: dict[int, int] | None, least: int) -> DataFrame:
        """Pairs of owners, at their own level, and rows of the other side, at levels of owners from its own + least on."""
        left = _binned(spread_a, "_before", "_after", size, "_a", levels_a, least)
        right = _binned(spread_b, "_from", "_to", size, "_b", levels_b, least)
        on = (F.col(f"A__{group}") == F.col(f"B__{group}")) & (F.col("_a_level") == F.col("_b_level")) & (F.col("_a_bin") == F.col("_b_bin"))
        on &= (F.col("_a_bin") == F.greatest("_a_first", "_b_first")) & (F.col("_to") >= F.col("_before")) & (F.col("_from") <= F.col("_after"))
        return left.join(right, on & same)

    pairs = met(None, owned_a, 0)
    if any(y > x for x in owned_a for y in owned_b):
        pairs = pairs.unionByName(met(owned_b, None, 1))
    start, end = relative(window)
    return pairs.select(F.col(f"A__{group}").alias(group), start.cast("long").alias("start"), end.cast("long").alias("end"), *named_a.columns, *named_b.columns)


def _levels(lo: str, hi: str, size: int) -> Column:
    """The level at which an interval touches a few bins: bins of level n are FANOUT ** n times as wide."""
    bins = F.greatest(F.floor((F.col(hi) - F.col(lo)) / size), F.lit(1)).cast("double")
    return F.greatest(F.floor(F.log2(bins) / F.log2(F.lit(float(FANOUT)))).cast("int"), F.lit(0))


def _owned(df: DataFrame, lo: str, hi: str, size: int) -> dict[int, int]:
    """How many intervals own each level; a dozen levels at most, as widths grow by powers."""
    found = df.groupBy(_levels(lo, hi, size).alias("level")).agg(F.count("*").alias("n")).collect()
    return {r.level: r.n for r in sorted(found, key=lambda r: r.level or 0) if r.level is not None}


def _dealt(df: DataFrame, owned: dict[int, int]) -> DataFrame:
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if sum(owned.values()) < SMALL else df


def _binned(df: DataFrame, lo: str, hi: str, size: int, name: str, levels: dict[int, int] | None, least: int) -> DataFrame:
    """df with its bins at its own level, or at each of the given levels from its own + least on."""
    own = F.array(_levels(lo, hi, size))
    at = own if levels is None else F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= own[0] + least)
    placed = df.withColumn(f"{name}_level", F.explode(at))
    wide = F.lit(size) * F.pow(F.lit(float(FANOUT)), F.col(f"{name}_level")).cast("long")
    bin_of = lambda c: F.floor(F.col(c) / wide)
    return placed.withColumns({f"{name}_first": bin_of(lo), f"{name}_bin": F.explode(F.sequence(bin_of(lo), bin_of(hi)))})


def relative(window: Window) -> tuple[Column, Column]:
    """Coordinates of B relative to A, mirrored where flipped, and quantised if the window has bins."""
    shift, wide = F.lit(window.left), F.col("_after") - F.col("_before")
    ahead_s, ahead_e = F.col("B__start") - F.col("_before"), F.col("B__end") - F.col("_before")
    behind_s, behind_e = F.col("_after") - F.col("B__end"), F.col("_after") - F.col("B__start")
    s, e = F.when(F.col("_flip"), behind_s).otherwise(ahead_s), F.when(F.col("_flip"), behind_e).otherwise(ahead_e)
    if window.bins <= 0:
        return s - shift, e - shift
    div = lambda x, y: F.call_function("div", x, y)  # noqa: E731  # towards zero
    safe, bins = F.greatest(wide, F.lit(1)), F.lit(window.bins)
    moved = div(bins * shift, safe)
    low = F.when(s <= 0, F.lit(0)).otherwise(div(bins * s, safe))
    high = F.when(e >= wide, wide - 1).otherwise(div(bins * e, safe))  # the clamp is the window's width less one, by design
    return div(wide * (low - moved), bins), div(wide * (high - moved), bins)


def clustered(df: DataFrame, group: str = "chr") -> DataFrame:
    """df by group and, within it, by start and end, as interval tables are stored."""
    return df.repartition(group).sortWithinPartitions(group, "start", "end")


def merged(df: DataFrame, group: str) -> DataFrame:
    """The union of half-open intervals of each group as disjoint intervals; those that touch become one.

    Intervals are cut at blocks of 2^20 positions and merged within each by a running maximum of their ends; what reaches a
    block's border, two rows for a block at most, is joined after.
    """
    from pyspark.sql.window import Window as W

    block, size = "_block", 1 << 20
    real = df.where(F.col("end") > F.col("start")).select(F.col(group).alias("_group"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    every = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias(block)
    cut = real.select("_group", "start", "end", every).select("_group", block, F.greatest("start", F.col(block) * size).alias("start"), F.least("end", (F.col(block) + 1) * size).alias("end"))

    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        by = W.partitionBy(*keys).orderBy("start", "end")
        reach = rows.withColumn("_reach", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)))
        runs = reach.withColumn("_run", F.sum(F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)).over(by))
        return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")

    inner = joined(cut, ["_group", block])
    edge = (F.col("start") % size == 0) | (F.col("end") % size == 0)
    apart = inner.where(~edge).select("_group", "start", "end")
    return apart.unionByName(joined(inner.where(edge).drop(block), ["_group"])).withColumnRenamed("_group", group)
