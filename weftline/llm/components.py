"""Connected components of an undirected graph as Spark joins (alternating large-star and small-star steps).

Edges stay distributed; the driver sees two numbers a round.  A hub is split: the minimum of each node's neighbours is
aggregated before the shuffle, and the rows of a node meet it under SALTS keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import discard, written

SALTS = 8


def _least(rows: DataFrame) -> DataFrame:
    """(u, v, m): each row with the smallest neighbour of u, or u where that is smaller."""
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    salted = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    return rows.withColumn("s", F.pmod(F.hash("v"), F.lit(SALTS))).join(salted.hint("merge"), ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(id, root) for each node that has an edge to another; root is the smallest id of its component.

    Self-loops, repeated edges and rows with a null end add nothing; no edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = written(pairs, name), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        linked = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        last, now = now, written(linked, name)
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
