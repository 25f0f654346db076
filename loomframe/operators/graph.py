"""Operators on node and edge tables."""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def successors(edges: DataFrame, node: int) -> DataFrame:
    """Targets of a node's edges; repeated edges give repeated rows."""
    return edges.filter(F.col("src") == node).select("dst")


def predecessors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("dst") == node).select("src")


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Nodes of two graphs in one id space: the second's ids follow the first's number of nodes."""
    shift = first.agg(F.count("*").alias("_shift"))
    return first.select("id", "name").unionByName(second.crossJoin(F.broadcast(shift)).select((F.col("id") + F.col("_shift")).alias("id"), "name"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological levels (id, level) by rounds; nodes on or behind cycles never appear.

    A round releases the nodes all of whose edges come from released nodes. Repeated edges are released together.
    The table of released nodes is written to a checkpoint each round where one is set, so plans stay short. A round
    is a job, so this is for graphs of many nodes and few levels.
    """
    spark = nodes.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df.persist())
    left = nodes.select("id").distinct()
    open_edges = edges.select("src", "dst")
    out = None
    for level in count():
        free = keep(left.join(open_edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        found = free.select("id", F.lit(level).cast("long").alias("level"))
        out = found if out is None else out.unionByName(found)
        left = keep(left.join(free, "id", "left_anti"))
        open_edges = keep(open_edges.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
    return out if out is not None else nodes.select("id", F.lit(0).cast("long").alias("level")).limit(0)


def parallel_pairs(members: DataFrame, group: str, node: str) -> DataFrame:
    """All ordered pairs of different members of a group: what runs side by side. The pairs are the result asked for."""
    a, b = members.select(group, F.col(node).alias("a")), members.select(group, F.col(node).alias("b"))
    return a.join(b, group).filter("a <> b")


def resolve_calls(calls: DataFrame, functions: DataFrame, callee: str, name: str, function_id: str) -> DataFrame:
    """Calls by name with the function's id: of functions of one name the last counts, unknown names are dropped."""
    known = functions.groupBy(F.col(name).alias(callee)).agg(F.max(function_id).alias("callee_id"))
    return calls.join(known, callee)


def chain(df: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """Transitions (src, dst) between neighbours of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).filter("dst is not null")


def bounds_below(bounds: list[float], key: Column) -> Column:
    """How many of the bounds (ascending) are less than the key, 0 for null: the part of 16 first, then the place in it.

    The key's expression is evaluated once, whatever the number of bounds: a lambda names its value.
    """
    parts = F.array(*[F.array(*map(F.lit, bounds[k : k + 16])).cast("array<double>") for k in range(0, len(bounds) + 1, 16)])
    ends = F.array(*map(F.lit, bounds[15::16])).cast("array<double>")
    less = lambda among, k: F.size(F.filter(among, lambda b: b < k))
    found = lambda k: F.get(F.transform(F.array(less(ends, k)), lambda p: p * 16 + less(F.get(parts, p), k)), 0)
    return F.get(F.transform(F.array(key), found), 0)


def positions(df: DataFrame, key: str, ties: list[str], buckets: int = 256, name: str = "position") -> DataFrame:
    """Rows numbered from 0 by a numeric key, without a task that sorts all of them.

    At most ``buckets`` quantiles of the key part the rows; only these and the number of rows in each come to the
    driver. Rows of one key stay together, so a key of many rows is one task's.
    """
    bounds = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [k / buckets for k in range(1, buckets)], 0.5 / buckets)))
    parted = df.withColumn("_bucket", bounds_below(bounds, F.col(key)))
    sizes = {row["_bucket"]: row["n"] for row in parted.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    before = [0, *accumulate(sizes.get(b, 0) for b in range(len(bounds)))]
    offset = F.get(F.array(*map(F.lit, before)), F.col("_bucket"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *ties)) - 1
    return parted.withColumn(name, offset.cast("long") + place).drop("_bucket")


def added(nodes: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Nodes with dense ids from ``start`` in the order they are added."""
    return positions(nodes, order, [], name="id").withColumn("id", F.col("id") + start)


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends; an end that is no node has none."""
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")


def independent_sets(levels: DataFrame) -> DataFrame:
    """The nodes of each level in ascending order: what may run side by side."""
    return levels.groupBy("level").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def regions(members: DataFrame, group: str, node: str) -> DataFrame:
    """A region for each group of two or more, and its edges to the members: (region, description, member)."""
    sized = members.groupBy(group).agg(F.count("*").alias("_n")).filter("_n >= 2")
    named = sized.select(group, F.format_string("Parallel region #%d: %d nodes", F.col(group).cast("long"), "_n").alias("description"))
    return members.join(named, group).select(F.col(group).alias("region"), "description", F.col(node).alias("member"))
