"""Connected components by alternating large-star and small-star, as joins and aggregations.

Edges with a null end and loops say nothing and are dropped; repeated edges and both directions of one count once;
no edges give no rows. Nodes are longs of any sign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: A hub's edges meet its minimum in this many tasks, before adaptive execution splits what is still skewed.
SALTS = 8


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the minimum m of their u; hubs are salted by their other end."""
    salted = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("t", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, (F.col("u") == F.col("k")) & (F.col("t") == F.col("s"))).select("u", "v", "m")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b: long).

    Every step is a minimum with map-side combine and a salted join; no neighbour list is built. Steps are written to
    the shared folder, and deleted once the next one stands."""
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = staged(_met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = _met(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        discard(e, large)
        e = after
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (row["n"], row["h"]):
            break
        state = (row["n"], row["h"])
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
