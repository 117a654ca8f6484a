"""Large sets of non-negative integers and how they relate.

A set is rows (set id, position).  For counting and boolean work it is also held compactly: one bitmap of 32,768 positions
for each bucket, built and combined with Spark's bitmap functions, so that positions never have to come together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.shared import in_order, unused, written


def from_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", pos: str = "pos") -> DataFrame:
    """Distinct positions of half-open intervals, overlapping or not."""
    return df.where(F.col(end) > F.col(start)).select(*keys, F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias(pos)).distinct()


def compact(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, bucket, bitmap)."""
    return df.groupBy(*keys, F.bitmap_bucket_number(pos).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bitmap"))


def restored(bitmaps: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, position) of compact sets: the reverse of compact."""
    byte, bit = unused([*keys, pos, "bucket", "bitmap"], "_byte", "_bit")
    value = F.conv(F.hex(F.substring("bitmap", F.col(byte) + 1, F.lit(1))), 16, 10).cast("int")
    bytes_ = bitmaps.select(*keys, "bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.octet_length("bitmap") - 1)).alias(byte))
    full = bytes_.select(*keys, "bucket", byte, value.alias(bit)).where(F.col(bit) > 0)
    ones = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.col(bit), k) == 1))
    # a bucket above 0 begins at 1, as Spark's bitmap functions number them; 0 is alone in bucket 0
    at = F.col(byte) * 8 + F.col(bit) + F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1).otherwise(0)
    return full.select(*keys, "bucket", byte, ones.alias(bit)).select(*keys, at.cast("long").alias(pos))


def _tagged(sets: list[DataFrame], pos: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [compact(s.select(pos), [], pos).withColumn("_of", F.lit(k)) for k, s in enumerate(sets)])


def intersect(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    return a.select(pos).intersect(b.select(pos))


def union(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    return a.select(pos).union(b.select(pos)).distinct()


def many_union(sets: list[DataFrame], pos: str = "pos") -> DataFrame:
    """Cardinality and bitmaps of a union of many sets: (bucket, bitmap)."""
    return _tagged(sets, pos).groupBy("bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))


def intersect_bitmaps(sets: list[DataFrame], pos: str = "pos") -> DataFrame:
    """(bucket, bitmap) of what all sets have; a bucket that one of them lacks is empty."""
    return _tagged(sets, pos).groupBy("bucket").agg(F.expr("bitmap_and_agg(bitmap)").alias("bitmap"), F.count("*").alias("_n")).where(F.col("_n") == len(sets)).drop("_n")


def exclusive(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """Positions in one of two sets: those that a full outer join leaves alone."""
    x, y = a.select(F.col(pos).alias("_x")).distinct(), b.select(F.col(pos).alias("_y")).distinct()
    return x.join(y, F.col("_x") == F.col("_y"), "full_outer").where("_x is null or _y is null").select(F.coalesce("_x", "_y").alias(pos))


def complement(a: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Positions of [0, size) that are not in the set."""
    return a.sparkSession.range(size).select(F.col("id").alias(pos)).join(a.select(pos), pos, "left_anti")


def cardinality(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, n) by way of bitmaps."""
    return compact(df, keys, pos).groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def size_of(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, size in bits, bytes held): one past the greatest position, and the length of the bitmaps."""
    held = compact(df, keys, pos).groupBy(*keys).agg(F.sum(F.octet_length("bitmap")).alias("bytes"))
    both = held.withColumn("size", F.lit(0).cast("long")).unionByName(df.groupBy(*keys).agg(F.lit(0).cast("long").alias("bytes"), (F.max(pos) + 1).cast("long").alias("size")))
    return both.groupBy(*keys).agg(F.max("size").alias("size"), F.max("bytes").alias("bytes"))


def members(df: DataFrame, asked: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, found) for each asked position."""
    own = df.select(F.col(pos).alias("_p")).distinct()
    return asked.select(pos).join(own, F.col(pos) == F.col("_p"), "left").select(pos, F.col("_p").isNotNull().alias("found"))


def next_one(df: DataFrame, after: int, size: int, pos: str = "pos") -> DataFrame:
    """The least position beyond one, or the size if there is none."""
    return df.where(F.col(pos) > after).agg(F.coalesce(F.min(pos), F.lit(size)).cast("long").alias("next"))


def with_bits(df: DataFrame, positions: list[int], pos: str = "pos") -> DataFrame:
    """The set with more positions."""
    more = df.sparkSession.createDataFrame([(p,) for p in positions], f"{pos} long")
    return union(df, more, pos)


def from_runs(runs: DataFrame, order: str, bit: str, length: str, pos: str = "pos") -> DataFrame:
    """Positions of a set given as runs of equal bits in order."""
    number, end = unused(runs.columns, "_number", "_end")
    placed = in_order(runs, [order], number, {end: length}).where((F.col(bit) == 1) & (F.col(length) > 0))
    return placed.select(F.explode(F.sequence(F.col(end) - F.col(length), F.col(end) - 1)).alias(pos))


def equal(a: DataFrame, b: DataFrame, pos: str = "pos") -> bool:
    return exclusive(a, b, pos).isEmpty()


def spans(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, first, last) of each run of neighbouring positions, both ends included.

    Runs are found within blocks of 2^20 positions and those that touch across a border are joined after, so that one set of
    any size is dealt over many tasks.
    """
    block = F.shiftright(F.col(pos), 20)
    rank = F.row_number().over(Window.partitionBy(*keys, block).orderBy(pos))
    inner = df.select(*keys, pos).distinct().withColumn("_run", F.col(pos) - rank).groupBy(*keys, block.alias("_block"), "_run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"))
    by = Window.partitionBy(*keys).orderBy("first") if keys else Window.orderBy("first")
    edge = (F.col("first") % (1 << 20) == 0) | ((F.col("last") + 1) % (1 << 20) == 0)
    apart, touching = inner.where(~edge).select(*keys, "first", "last"), inner.where(edge).select(*keys, "first", "last")
    new = F.coalesce((F.col("first") != F.lag("last").over(by) + 1).cast("int"), F.lit(1))
    chained = touching.withColumn("_new", new).withColumn("_group", F.sum("_new").over(by)).groupBy(*keys, "_group").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_group")
    return apart.unionByName(chained)


def collected(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, positions in order); for sets that fit a row."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(pos)).alias("positions"))


def _phi(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    product = (n11 + n10).cast("double") * (n01 + n00) * (n11 + n01) * (n10 + n00)
    return F.try_divide(n11.cast("double") * n00 - n10.cast("double") * n01, F.sqrt(product))


#: Sets of a block: a task holds the bitmaps of two blocks in one bucket, 4,096 bytes each.
SIDE = 256


def common(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """(a, b, n11) of every pair of sets a < b with common positions.

    Sets are numbered and fall into blocks of SIDE.  In each bucket of positions two blocks meet as bitmaps, and one product of
    matrices counts the common positions of all their pairs; a task adds up the buckets that it sees.  So a position of
    all sets costs a bit of each, and no row for each pair.
    """
    bitmaps = compact(df.select(F.col(key).alias("_k"), F.col(pos).cast("long").alias("_p")).where("_k is not null and _p is not null"), ["_k"], "_p")
    numbered = written(in_order(bitmaps.select("_k").distinct(), ["_k"], "_i"), "numbered")
    blocks = (numbered.count() + SIDE - 1) // SIDE
    own = F.expr(f"cast(_i div {SIDE} as int)")
    # a block meets those before it, itself, and those after it
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(0, blocks - 1))), lambda y: F.struct(F.least(own, y).alias("x"), F.greatest(own, y).alias("y")))).alias("pair")
    met = bitmaps.join(numbered, "_k").select("bucket", F.col("_i").alias("i"), "bitmap", pair).select(F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "bucket", "i", "bitmap")
    dealt = met.repartition("x", "y", "bucket").sortWithinPartitions("x", "y", "bucket", "i")
    n11 = dealt.mapInArrow(_products, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n11"))
    name = lambda i, c: numbered.select(F.col("_i").alias(i), F.col("_k").alias(c))
    return n11.join(name("i", "a"), "i").join(name("j", "b"), "j").select("a", "b", "n11")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, common positions) of the pairs of each two blocks, from rows in order of blocks and buckets."""
    total, blocks, bucket = np.zeros((SIDE, SIDE), np.int64), None, None
    held: list[tuple[int, bytes]] = []

    def multiplied() -> None:
        x, y = blocks
        sides = [[r for r in held if r[0] // SIDE == z] for z in (x, y)]
        if all(sides):
            bits = [np.unpackbits(np.frombuffer(b"".join(b for _, b in side), np.uint8).reshape(len(side), -1), axis=1).astype(np.float32) for side in sides]
            at = [np.array([i % SIDE for i, _ in side]) for side in sides]
            total[np.ix_(*at)] += (bits[0] @ bits[1].T).astype(np.int64)  # at most 32,768, exact in 32 bits
        held.clear()

    def told() -> pa.RecordBatch:
        i, j = np.nonzero(total)
        n = total[i, j]
        total[:] = 0
        i, j = i + blocks[0] * SIDE, j + blocks[1] * SIDE
        kept = i < j
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (i, j, n)], names=["i", "j", "n"])

    for batch in batches:
        for x, y, at, i, bitmap in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "bucket", "i", "bitmap")), strict=True):
            if blocks is not None and (x, y, at) != (*blocks, bucket):
                multiplied()
                if (x, y) != blocks:
                    yield told()
            blocks, bucket = (x, y), at
            held.append((i, bitmap))
    if blocks is not None:
        multiplied()
        yield told()


def _cardinalities(df: DataFrame, key: str, pos: str, size: int | None) -> tuple[DataFrame, DataFrame, Column]:
    """(distinct (k, p), (k, c), the universe's size)."""
    universe = F.lit(size) if size else F.lit(df.agg(F.max(pos)).first()[0]) + 1
    own = df.select(F.col(key).alias("k"), F.col(pos).alias("p")).where("k is not null and p is not null").distinct()
    return own, own.groupBy("k").agg(F.count("*").alias("c")), universe


def all_pairs_phi(df: DataFrame, key: str, pos: str = "pos", size: int | None = None) -> DataFrame:
    """(a, b, n11, phi) of every pair of sets a < b, over a universe of ``size`` positions (one past the greatest by default).
    Common positions are counted by blocks (``common``); the pairs themselves, one row for two sets, are the result."""
    _, counts, universe = _cardinalities(df, key, pos, size)
    left, right = counts.select(F.col("k").alias("a"), F.col("c").alias("ca")), counts.select(F.col("k").alias("b"), F.col("c").alias("cb"))
    met = left.join(right, F.col("a") < F.col("b")).join(common(df, key, pos), ["a", "b"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)).cast("long"))
    n11, ca, cb = F.col("n11"), F.col("ca"), F.col("cb")
    return met.select("a", "b", "n11", _phi(n11, ca - n11, cb - n11, universe - ca - cb + n11).alias("phi"))


#: Rank error of the sketches that cut prefixes, as a share of a set.
PREFIX_ERROR = 1e-3


def similar_pairs(df: DataFrame, key: str, least: float, pos: str = "pos", size: int | None = None) -> DataFrame:
    """(a, b, n11, phi) of the pairs of sets a < b with a phi of at least ``least``, above 0; no other pairs are counted.

    With t the threshold and n the universe, a set of c positions reaches t only with one of at least
    lo(c) = t^2 c n / (n - c + t^2 c) positions, shares as many with it at least (that bound is concave in the other's size, so its ends
    decide), and is bounded the same way from above.  So of all positions in an order of rarity, two such sets share one
    among the first c - lo(c) + 1 of each: only these prefixes are joined.  Prefixes are cut by a mergeable sketch of each
    set's places in that order, a little late by its rank error, which loses nothing.  Candidates are counted exactly, 64
    positions at a time.  Sets that are empty or have all positions have no phi.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    own, counts, universe = _cardinalities(df, key, pos, size)
    t2, c = F.lit(least * least), F.col("c").cast("double")
    n = universe.cast("double")
    low = t2 * c * n / (n - c + t2 * c)
    rare = in_order(own.groupBy("p").agg(F.count("*").alias("f")), ["f", "p"], "g").select("p", "g")
    sized = written(counts.where(F.col("c") < universe).withColumn("share", (c - F.ceil(low - 1e-6) + 1) / c + 2 * PREFIX_ERROR), "sets")
    placed = written(own.join(rare, "p").join(sized, "k"), "places")
    # the least place that at least the share of the set's positions do not pass: one of a hundred marks, the last of which is the whole set
    marks = [(i + 1) / 100 for i in range(100)]
    sketch = placed.groupBy("k").agg(F.first("share").alias("s"), F.percentile_approx("g", [min(1.0, m + PREFIX_ERROR) for m in marks], int(1 / PREFIX_ERROR)).alias("m"), F.max("g").alias("top"))
    cut = F.when(F.col("s") >= 1, F.col("top")).otherwise(F.get("m", F.ceil(F.col("s") * 100).cast("int") - 1))
    prefixes = placed.join(sketch.select("k", cut.alias("cut")), "k").where(F.col("g") <= F.col("cut")).select("k", "p", "c")
    left, right = (prefixes.select(F.col("k").alias(k), "p", F.col("c").alias(f"c{k}")) for k in "ab")
    small, great = F.least("ca", "cb").cast("double"), F.greatest("ca", "cb").cast("double")
    reachable = small * (n - great) >= t2 * great * (n - small) * (1 - 1e-9)
    pairs = left.join(right, "p").where((F.col("a") < F.col("b")) & reachable).select("a", "b", "ca", "cb").distinct()
    words = own.groupBy("k", F.expr("shiftright(p, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    x, y = words.select(F.col("k").alias("a"), "w", F.col("bits").alias("x")), words.select(F.col("k").alias("b"), "w", F.col("bits").alias("y"))
    met = pairs.join(x, "a").join(y, ["b", "w"]).groupBy("a", "b", "ca", "cb").agg(F.sum(F.bit_count(F.col("x").bitwiseAND(F.col("y")))).cast("long").alias("n11"))
    n11, ca, cb = F.col("n11"), F.col("ca"), F.col("cb")
    return met.select("a", "b", "n11", _phi(n11, ca - n11, cb - n11, universe - ca - cb + n11).alias("phi")).where(F.col("phi") >= least - 1e-9)


def closest_pair(df: DataFrame, key: str, pos: str = "pos", size: int | None = None) -> DataFrame:
    """(a, b, n11, phi) of the pair of sets with the greatest phi; of equal ones the first.

    Equal sets are found by a hash of their positions and their number, without pairs, and settle it.  Otherwise thresholds fall
    until some pair reaches one (``similar_pairs``); only if none reaches the last are all pairs counted.
    """
    own, counts, universe = _cardinalities(df, key, pos, size)
    hashed = own.groupBy("k").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("p")).alias("h1"), F.bit_xor(F.xxhash64("p", F.lit(1))).alias("h2"))
    twice = hashed.where(F.col("c") < universe).withColumn("r", F.row_number().over(Window.partitionBy("c", "h1", "h2").orderBy("k"))).where("r <= 2")
    same = twice.groupBy("c", "h1", "h2").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).where("n = 2")
    found = same.agg(F.min(F.struct("a", "b", F.col("c").alias("n11"), F.lit(1.0).alias("phi"))).alias("p")).where("p is not null").select("p.*")
    if not found.isEmpty():
        return found
    apart = written(own.select(F.col("k").alias(key), F.col("p").alias(pos)), "sets")
    n = size or ((apart.agg(F.max(pos)).first()[0] or 0) + 1)
    pairs = None
    for least in (0.9, 0.7, 0.5, 0.3, 0.15):
        pairs = written(similar_pairs(apart, key, least, pos, n), "pairs")
        if not pairs.isEmpty():
            break
    else:
        pairs = all_pairs_phi(apart, key, pos, n).where("phi is not null")
    top = pairs.join(F.broadcast(pairs.agg(F.max("phi").alias("top"))), F.col("phi") == F.col("top"))
    return top.agg(F.min(F.struct("a", "b", "n11", "phi")).alias("p")).where("p is not null").select("p.*")


def phi(a: DataFrame, b: DataFrame, size: int | None = None, pos: str = "pos") -> DataFrame:
    """(n11, n10, n01, n00, phi) of two sets; null where a margin is zero."""
    flags = a.select(pos).distinct().withColumn("_a", F.lit(1)).join(b.select(pos).distinct().withColumn("_b", F.lit(1)), pos, "full_outer")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    counts = flags.agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), (F.lit(size) if size else F.max(pos) + 1).cast("long").alias("size"))
    found = counts.select("n11", "n10", "n01", (F.col("size") - F.col("n11") - F.col("n10") - F.col("n01")).alias("n00"))
    return found.withColumn("phi", _phi(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")))


def phi_of_union(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """(n11, n10, n01, phi) with the union as the universe, in which n11 takes the place of n00."""
    n11, n10, n01 = F.col("n11"), F.col("n10"), F.col("n01")
    counts = phi(a, b, None, pos).select("n11", "n10", "n01")
    product = (n11 + n10).cast("double") * (n01 + n11) * (n11 + n01) * (n10 + n11)
    return counts.withColumn("phi", F.try_divide(n11.cast("double") * n11 - n10.cast("double") * n01, F.sqrt(product)))


#: Runs of a block: what a task of the permutation test lays out at once.
LAID = 1 << 17
#: A length that fewer runs have than this is dealt run by run, and others by one draw for all blocks.
FEW = 256


def permutation_test(a: DataFrame, b: DataFrame, size: int, times: int = 100, seed: int = 7, pos: str = "pos") -> DataFrame:
    """(observed, at_least, times): how many random rearrangements of both sets' runs overlap at least as much as they do.

    A rearrangement draws an order for the runs and one for the gaps of each set and lays them out alternately, beginning with
    either.  Only lengths matter, so what is drawn is how many runs of each length fall to each bucket of an order (each run to any
    bucket alike), and then the order within a bucket, where it is laid out: an order of all runs in which each is as likely.  Both are drawn
    from seeds, so no run of a replicate is ever a row.  A task lays out the runs of LAID places, whose positions follow from the sums of the buckets
    before, as bitmaps, and those of both sets meet by bucket of positions.
    """
    spark = a.sparkSession
    observed = intersect(a, b, pos).count()

    def lengths(s: DataFrame) -> DataFrame:
        """(bit, n, own): how many runs of ones (bit 1) and of zeros are n long."""
        runs = written(spans(s, [], pos).select("first", (F.col("last") + 1).alias("end")), "runs")  # the ranges of an order read it twice
        ones = in_order(runs, ["first"], "k")
        ahead = ones.select((F.col("k") - 1).alias("k"), F.col("first").alias("next"))
        gaps = ones.join(ahead, "k", "left").select((F.coalesce("next", F.lit(size)) - F.col("end")).cast("long").alias("n"))
        lead = ones.where("k = 0").select(F.col("first").cast("long").alias("n"))
        run = lambda df, bit: df.where("n > 0").select(F.lit(bit).cast("long").alias("bit"), "n")
        runs = run(runs.select((F.col("end") - F.col("first")).cast("long").alias("n")), 1).unionAll(run(gaps, 0)).unionAll(run(lead, 0))
        return runs.groupBy("bit", "n").agg(F.count("*").alias("own"))

    kinds = written(reduce(DataFrame.unionByName, [lengths(s).withColumn("of", F.lit(k).cast("long")) for k, s in enumerate((a, b), 1)]), "lengths")
    # the longest order decides; runs and gaps of a set differ by one at most
    most = kinds.groupBy("of", "bit").agg(F.sum("own").alias("own")).agg(F.coalesce(F.max("own"), F.lit(0))).first()[0]
    buckets = max(1, -(-most // LAID))
    copies = kinds.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")))).withColumn("draw", F.xxhash64(F.lit(seed), "of", "rep", "bit", "n"))
    dealt = written(copies.repartition("of", "rep", "bit", "n").mapInArrow(_dealt(buckets), "of long, rep long, bit long, bucket long, n long, own long"), "dealt")
    order = ["of", "rep", "bit"]
    ahead = Window.partitionBy(*order).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    ends = dealt.groupBy(*order, "bucket").agg(F.sum("own").alias("held"), F.sum(F.col("n") * F.col("own")).alias("reach"))
    placed = ends.select(*order, "bucket", "held", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("first"), F.coalesce(F.sum("reach").over(ahead), F.lit(0)).alias("before"))
    # a bucket is wanted by every block of places that it reaches, and by the one that begins where it ends
    block = F.explode(F.sequence(F.expr(f"first div {LAID}"), F.expr(f"(first + held) div {LAID}"))).alias("block")
    met = dealt.join(placed.select(*order, "bucket", "first", "before", block), [*order, "bucket"]).withColumn("ones_lead", F.pmod(F.xxhash64(F.lit(seed), "of", "rep"), F.lit(2)))
    # few small rows are much work: as many tasks as a shuffle has, which adaptive execution must not merge
    rows = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "of", "rep", "block").sortWithinPartitions("of", "rep", "block", "bit", "bucket", "n")
    laid = rows.select(*_PLACED).mapInArrow(_laid(seed), "of long, rep long, bucket long, bitmap binary").repartition("rep", "bucket")
    # rows are dealt by replicate and bucket already: no further exchange for either
    whole = laid.groupBy("rep", "bucket", "of").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    both = whole.groupBy("rep", "bucket").agg(F.expr("bitmap_and_agg(bitmap)").alias("bitmap"), F.count("*").alias("sets")).where("sets = 2")
    overlaps = both.groupBy("rep").agg(F.sum(F.bitmap_count("bitmap")).alias("overlap"))
    every = spark.range(times).select(F.col("id").alias("rep")).join(overlaps, "rep", "left").select(F.coalesce("overlap", F.lit(0)).alias("overlap"))
    return every.agg(F.lit(observed).cast("long").alias("observed"), F.count_if(F.col("overlap") >= observed).alias("at_least"), F.count("*").alias("times"))


def _dealt(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many runs of each length fall to each bucket, each run to any alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, draw = batch.column("own").to_numpy(), batch.column("draw").to_numpy().view(np.uint64)
            at, to, n = [], [], []
            few = np.flatnonzero(own < FEW)
            each = np.repeat(few, own[few])
            place = (np.arange(len(each)) - np.repeat(np.cumsum(own[few]) - own[few], own[few])).astype(np.uint64)
            pairs, counts = np.unique(each * buckets + (_mixed(draw[each] + place * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64), return_counts=True)
            at.append(pairs // buckets)
            to.append(pairs % buckets)
            n.append(counts)
            for i in np.flatnonzero(own >= FEW).tolist():
                drawn = np.random.default_rng(int(draw[i])).multinomial(own[i], np.full(buckets, 1 / buckets))
                to.append(np.flatnonzero(drawn))
                at.append(np.full(len(to[-1]), i))
                n.append(drawn[to[-1]])
            rows = pa.array(np.concatenate(at))
            kept = [batch.column(c).take(rows) for c in ("of", "rep", "bit", "n")]
            yield pa.RecordBatch.from_arrays([*kept[:3], pa.array(np.concatenate(to)), kept[3], pa.array(np.concatenate(n))], names=["of", "rep", "bit", "bucket", "n", "own"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all of a number's (the last step of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACED = ["of", "rep", "block", "bit", "bucket", "first", "before", "n", "own", "ones_lead"]


def _laid(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bitmaps of the ones of each block of places, from rows in order of blocks and buckets."""

    def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        of, rep, block = rows[:3, 0].tolist()
        begin, ones_lead = block * LAID, bool(rows[9, 0])
        base, lengths = [0, 0], [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for bit in (0, 1):
            side = rows[:, rows[3] == bit]
            edges = np.flatnonzero(np.diff(side[4])) + 1
            for part in np.split(side, edges, axis=1) if side.size else []:
                bucket, first, before = part[4:7, 0].tolist()
                order = np.repeat(part[7], part[8])
                np.random.default_rng([seed % (1 << 63), of, rep, bit, bucket]).shuffle(order)
                if first <= begin:
                    base[bit] = before + int(order[: begin - first].sum())
                lengths[bit] = np.concatenate([lengths[bit], order[max(0, begin - first) : begin + LAID - first]])
        ones, gaps = lengths[1], np.zeros(len(lengths[1]), np.int64)
        there = min(len(ones), len(lengths[0]))
        gaps[:there] = lengths[0][:there]
        ends = np.cumsum(ones) + np.cumsum(gaps) - (gaps if ones_lead else 0) + base[0] + base[1]
        for at, bitmaps in _bitmaps(ends - ones, ends):
            columns = [np.full(len(at), of), np.full(len(at), rep), at]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([x.tobytes() for x in bitmaps], pa.binary())], names=["of", "rep", "bucket", "bitmap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in _PLACED])
            for part in np.split(rows, np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1, axis=1):
                if held and part.size and (held[-1][:3, -1] != part[:3, 0]).any():
                    yield from told(np.concatenate(held, axis=1))
                    held = []
                held += [part] if part.size else []
        if held:
            yield from told(np.concatenate(held, axis=1))

    return run


def _bitmaps(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of 32,768 positions, their bitmaps) of runs in order that do not overlap, up to 256 buckets at once."""
    start, i = start.copy(), 0
    while i < len(start):
        stop = ((int(start[i]) >> 23) + 1) << 23
        j = int(np.searchsorted(start, stop))
        first, last = start[i:j], np.minimum(end[i:j], stop) - 1
        # runs are cut at the borders of buckets
        parts = (last >> 15) - (first >> 15) + 1
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        bucket = np.repeat(first >> 15, parts) + step
        low = np.maximum(np.repeat(first, parts), bucket << 15) & 32767
        high = np.minimum(np.repeat(last, parts), (bucket << 15) + 32767) & 32767
        there, row = np.unique(bucket, return_inverse=True)
        a, b = row * 4096 + (low >> 3), row * 4096 + (high >> 3)
        head, tail = (0xFF << (low & 7)) & 0xFF, 0xFF >> (7 - (high & 7))
        # bytes between the first and the last of a run are full; no two runs have such bytes behind the same byte
        wide = a < b
        turns = np.zeros(len(there) * 4096 + 1, np.int8)
        turns[a[wide] + 1] += 1
        turns[b[wide]] -= 1
        full = (-np.cumsum(turns[:-1], dtype=np.int8)).view(np.uint8)
        np.bitwise_or.at(full, a, np.where(wide, head, head & tail).astype(np.uint8))
        np.bitwise_or.at(full, b[wide], tail[wide].astype(np.uint8))
        yield there, full.reshape(-1, 4096)
        if end[j - 1] > stop:  # the rest of a run that crosses
            start[j - 1] = stop
            j -= 1
        i = j


def random_set(spark, n: int = 25, length: int = 100, most: int = 10_000, seed: int = 7, pos: str = "pos") -> DataFrame:
    """Positions of n runs of a length that start at random below ``most``; overlaps merge."""
    starts = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most)).alias("start"))
    return from_intervals(starts.withColumn("end", F.col("start") + length), [], pos=pos)
