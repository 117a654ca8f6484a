"""Semi-joins, chains of them, keyed upserts, and walks over trees of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.shared import new_dir, unused, written
from weftline.plans.select import condition, query


def semi_join(left: DataFrame, right: DataFrame, select1: str, select2: str, on: str, where1: str | None = None, where2: str | None = None) -> DataFrame:
    """Rows of right that where2 keeps and whose column ``on`` is among the values of the first column that select1 takes
    from left.  Right rows are never multiplied; Spark plans one left-semi join."""
    keys = query(left, select1, where1)
    [key] = unused(right.columns, "_key")
    return query(right.where(condition(where2)).join(keys.select(F.col(keys.columns[0]).alias(key)), F.col(on) == F.col(key), "left_semi"), select2)


def semi_chain_count(steps: list[tuple[DataFrame, str | None, str | None, str]], group: str, tally: str = "tally") -> DataFrame:
    """Each step is (table, where, column that must match the step before or None, column handed on); the last step's rows are
    counted by ``group``.  What a step hands on is distinct by the semi-join."""
    table, where, _, out = steps[0]
    rows = table.where(condition(where))
    for follower, where, match, following in steps[1:]:
        [key] = unused(follower.columns, "_key")
        rows = follower.where(condition(where)).join(rows.select(F.col(out).alias(key)), F.col(match) == F.col(key), "left_semi")
        out = following
    return rows.groupBy(group).agg(F.count("*").alias(tally))


def _missing(kind: T.DataType) -> Column:
    return F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)


def upsert_column(table: DataFrame, values: DataFrame, key: str, value: str, fill: bool = True) -> DataFrame:
    """table with the column ``value`` of values by key: known keys take it, missing ones get 0 or '' (null with fill=False),
    and unknown keys are added with the other columns filled the same way."""
    base = table.drop(value)
    k, v = unused(base.columns, "_key", "_value")
    new = values.select(F.col(key).alias(k), F.col(value).alias(v))
    met = base.join(new, base[key] == new[k], "full_outer")
    pad = (lambda c, kind: F.coalesce(c, _missing(kind))) if fill else (lambda c, kind: c)
    columns = [F.coalesce(F.col(key), F.col(k)).alias(key) if c == key else pad(F.col(c), base.schema[c].dataType).alias(c) for c in base.columns]
    return met.select(*columns, pad(F.col(v), new.schema[v].dataType).alias(value))


def load_key_values(rows: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One row for each key: empty or zero keys and values are left out, and of repeated keys the last by ``order`` wins.  Without
    it that is the last by row id, which is the order of the rows of one file; rows of several files carry their order
    from the reader (``readers.key_values(..., order="at")``)."""
    real = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0")
    [at] = unused(rows.columns, "_at")
    placed = rows.withColumn(at, F.col(order) if order else F.monotonically_increasing_id())
    return placed.where(real(key) & real(value)).groupBy(key).agg(F.max_by(value, at).alias(value))


def lookup(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner equi-join; rows without a match are dropped.  Spark broadcasts the table if its size allows."""
    return rows.join(table, on, "inner")


def tree_paths(edges: DataFrame, root: str, child: str = "child", parent: str = "parent", separator: str = "/") -> DataFrame:
    """(node, depth, path from the root) of every node that reaches the root, at any depth and of any number.

    In a tree ancestors are found by doubling: a row holds the ancestor at distance 2^k and the names between, and one join sets it
    before the row of that ancestor.  So depth 10,000 takes 15 joins, a path is put together from as many pieces at most, and rows
    that have reached the root are not touched again.  Depths have no gap, so when a round brings no further node to the
    root, the rest are loops or end elsewhere.  Where a node has several parents, each of its paths is a row, and they are
    walked level by level (see ``_walked``).
    """
    name = lambda c: F.col(c).cast("string")
    known = edges.where(F.col(child) != F.col(parent)).select(name(child).alias("c"), name(parent).alias("p")).where(F.col("c") != str(root))
    real = written(known.distinct(), "edges")
    if not real.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _walked(real, str(root), separator)
    top, apart = F.lit(str(root)), F.lit(separator)
    rows, done = written(real.select(F.col("c").alias("node"), F.col("p").alias("up"), F.lit(1).alias("depth"), F.col("c").alias("piece")), "tree"), []
    while True:
        arrived, rest = rows.where(F.col("up") == top), rows.where(F.col("up") != top)
        if arrived.isEmpty():
            break
        done.append(arrived)
        if rest.isEmpty():
            break
        ahead = reduce(DataFrame.unionByName, [*done, rest]).select(F.col("node").alias("at"), F.col("up").alias("over"), F.col("depth").alias("more"), F.col("piece").alias("before"))
        jumped = rest.join(ahead, F.col("up") == F.col("at"))
        rows = written(jumped.select("node", F.col("over").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("before", apart, "piece").alias("piece")), "tree")
    first = edges.sparkSession.range(1).select(top.alias("node"), F.lit(0).alias("depth"), top.alias("path"))
    return reduce(DataFrame.unionByName, [first, *[d.select("node", "depth", F.concat(top, apart, "piece").alias("path")) for d in done]])


def _walked(real: DataFrame, root: str, separator: str) -> DataFrame:
    """All paths from the root: one join for each level, the nodes of a level written to the shared folder, until one is empty.
    A node that is on its own path already is not entered again, so loops end."""
    spark = real.sparkSession
    folder = new_dir(spark, "tree")
    level = spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"), F.array(F.lit(root)).alias("trail"))
    kinds, levels = level.schema, []
    while True:
        levels.append(f"{folder}/{len(levels)}")
        level.write.option("compression", "zstd").parquet(levels[-1])
        level = spark.read.schema(kinds).parquet(levels[-1])
        if level.isEmpty():
            break
        following = real.join(level, F.col("p") == F.col("node")).where(~F.array_contains("trail", F.col("c")))
        level = following.select(F.col("c").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("trail", F.array("c")).alias("trail"))
    return spark.read.schema(kinds).parquet(*levels).select("node", "depth", F.array_join("trail", separator).alias("path"))


def tree_children(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(parent, children in order) without loops of a node to itself."""
    return edges.where(F.col(child) != F.col(parent)).groupBy(F.col(parent).alias("node")).agg(F.sort_array(F.collect_set(child)).alias("children"))
