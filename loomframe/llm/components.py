"""Connected components of an edge table by alternating large and small stars, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.shared import dropped, written

#: A node's edges are dealt to so many tasks where its least neighbour is looked up.
SALTS = 8


def _least(edges: DataFrame) -> DataFrame:
    """Each (node, other) with the least of the node and all its others."""
    least = edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int")).join(least, ["node", "salt"])


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    large = _least(both).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
    small = _least(large)
    return small.select(F.col("node"), F.col("least").alias("other")).unionByName(small.select(F.col("other").alias("node"), F.col("least").alias("other"))).filter("node > other").distinct()


def _stars(edges: DataFrame) -> bool:
    """True if every node has one edge, to a root that has none: then the roots are the components."""
    ends = edges.select(F.col("node").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("other").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or up > 0 and root > 0").isEmpty()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): component is the smallest node reachable, for every node that has an edge.

    Loops, nulls and repeated edges have no effect; without edges the result is empty.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = written(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    while not _stars(now):
        after = written(_round(now), "edges")
        dropped(now)
        now = after
    return now.select("node", F.col("other").alias("component")).unionByName(now.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct())
