"""Near-duplicate embeddings of equal labels: dual traversal of cover trees.

Equal vectors of a label are one class. The classes of a label are dealt to
blocks around pivots, and each block gets a cover tree: nested levels whose radii
halve, where a node's own centre is the first centre of the level below. Two
trees are traversed together; a pair of nodes whose centres are further apart than
both covering radii and the threshold's distance is pruned with all below it,
and surviving points are compared by their cosine. Pairs of blocks are pruned
by the same bound before any tree is sent: first by the cells of their pivots, then
by the trees' roots. A block with many partners meets them in several tasks.

A pair of trees gives link counts and a spanning forest of its links, at most a
row for each vector, never the pairs themselves.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.components import components
from loomframe.llm.shared import dropped, hot_join, partitions, written
from loomframe.llm.vectors import keyed, valid_vector

LEAF = 32
#: Partners of a block that one task compares it with.
PARTNERS = 8
#: Slack of the bounds, over the rounding of distances.
SLACK = 1e-7


class Node:
    __slots__ = ("centre", "radius", "points", "children", "centres", "radii")

    def __init__(self, centre: int, radius: float, points: np.ndarray):
        self.centre, self.radius, self.points, self.children, self.centres, self.radii = centre, radius, points, None, None, None


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """The root over unit vectors ``x``; a node's points all lie within its radius of its centre, a member."""
    mean = x.mean(axis=0)
    first = int((x @ mean).argmax())
    root = Node(first, _reach(x, first, np.arange(len(x))), np.arange(len(x)))
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if len(node.points) <= leaf or node.radius <= SLACK:
            continue
        half = node.radius / 2
        left, children, centre = node.points, [], node.centre
        while len(left):
            near = _distance(x[left], x[centre]) <= half
            near |= left == centre
            child = Node(centre, 0.0, left[near])
            child.radius = _reach(x, centre, child.points)
            children.append(child)
            left = left[~near]
            if len(left):
                centre = int(left[0])
        node.children = children
        node.centres, node.radii = np.array([c.centre for c in children]), np.array([c.radius for c in children])
        open_nodes += children
    return root


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def _reach(x: np.ndarray, centre: int, points: np.ndarray) -> float:
    return float(_distance(x[points], x[centre]).max())


def dual_traversal(ta: Node, xa: np.ndarray, tb: Node, xb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs with cosine >= least; rows are unit vectors in double precision."""
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    out_i, out_j, todo = [], [], [(ta, tb)]
    while todo:
        a, b = todo.pop()
        if a.children is None and b.children is None:
            hit = np.argwhere(xa[a.points] @ xb[b.points].T >= least)
            out_i.append(a.points[hit[:, 0]])
            out_j.append(b.points[hit[:, 1]])
            continue
        ca, ra = (a.centres, a.radii) if a.children is not None else (np.array([a.centre]), np.array([a.radius]))
        cb, rb = (b.centres, b.radii) if b.children is not None else (np.array([b.centre]), np.array([b.radius]))
        keep = np.argwhere(_distance(xa[ca], xb[cb]) <= ra[:, None] + rb + reach)
        todo += [(a.children[i] if a.children is not None else a, b.children[j] if b.children is not None else b) for i, j in keep.tolist()]
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _trees(group: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(group["vec"].to_numpy()).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    root = cover_tree(unit)
    blob = pickle.dumps((group["id"].to_numpy(), group["copies"].to_numpy(), unit, root))
    return pd.DataFrame({"block": [group["block"].iloc[0]], "grp": [group["grp"].iloc[0]], "cell": [group["cell"].iloc[0]], "high": [float(group["dist"].max())], "centre": [unit[root.centre].tolist()], "radius": [root.radius], "tree": [blob]})


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index linked with each of n, by passing least labels along links."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(least: float):
    """Streams (block, part, role, tree): the block's own tree first, then its partners. Gives (id, more links, an id it is linked with).

    In the first part the block is compared with itself, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            trees = batch.column("tree")
            for k, (part, role) in enumerate(zip(batch.column("part").to_pylist(), batch.column("role").to_pylist())):
                theirs = pickle.loads(trees[k].as_buffer())
                if role == 0:
                    own = theirs
                    if part:
                        continue
                ids_a, copies_a, xa, ta = own
                ids_b, copies_b, xb, tb = theirs
                same = role == 0
                i, j = dual_traversal(ta, xa, tb, xb, least)
                if same:
                    i, j = i[i != j], j[i != j]
                    ids, n = ids_a, len(ids_a)
                    more = np.bincount(i, copies_b[j], n)
                    label = _forest(n, i, j)
                else:
                    ids, n = np.concatenate([ids_a, ids_b]), len(ids_a) + len(ids_b)
                    more = np.concatenate([np.bincount(i, copies_b[j], len(ids_a)), np.bincount(j, copies_a[i], len(ids_b))])
                    label = _forest(n, i, j + len(ids_a))
                hit = np.flatnonzero(more)
                if len(hit):
                    yield pa.record_batch({"id": ids[hit], "more": more[hit].astype(np.int64), "to": ids[label[hit]]})

    return run


def block_pairs(trees: DataFrame, pivots: dict[str, np.ndarray], least: float) -> DataFrame:
    """Pairs (block, other) of blocks that may hold a link, written; each pair once.

    The pivots of cells, at most ``PIVOTS``, and the furthest row of each are known to the driver, which gives the pairs
    of cells that are near enough; blocks are joined on these pairs, never on a group alone, then by their roots.
    """
    spark = trees.sparkSession
    reach = float(np.sqrt(2 - 2 * least)) + 2 * SLACK
    outline = trees.select("block", "grp", "cell", "high", "centre", "radius")
    furthest: dict[str, dict[int, float]] = {}
    for x in outline.filter(F.col("grp").isin(*pivots)).groupBy("grp", "cell").agg(F.max("high").alias("high")).collect() if pivots else []:
        furthest.setdefault(x["grp"], {})[x["cell"]] = x["high"]

    def near_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, cell in zip(batch.column("grp").to_pylist(), batch.column("cell").to_pylist()):
                others = np.array(sorted(c for c in furthest[grp] if c >= cell))
                high = np.array([furthest[grp][c] for c in others])
                apart = np.sqrt(((pivots[grp][others] - pivots[grp][cell]) ** 2).sum(axis=1))
                others = others[apart <= furthest[grp][cell] + high + reach]
                yield pa.record_batch({"grp": pa.array([grp] * len(others), pa.string()), "cell": pa.array([cell] * len(others), pa.int32()), "other_cell": pa.array(others, pa.int32())})

    cells = outline.select("grp", "cell").distinct()
    near = cells.filter(F.col("grp").isin(*pivots)).mapInArrow(near_cells, "grp string, cell int, other_cell int") if pivots else None
    alone = cells.filter(~F.col("grp").isin(*pivots)) if pivots else cells
    alone = alone.select("grp", "cell", F.col("cell").alias("other_cell"))
    near = alone if near is None else near.unionByName(alone)
    other = outline.select("grp", F.col("cell").alias("other_cell"), F.col("block").alias("other"), F.col("centre").alias("other_centre"), F.col("radius").alias("other_radius"))
    dot = F.aggregate(F.zip_with("centre", "other_centre", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    once = (F.col("cell") < F.col("other_cell")) | (F.col("block") < F.col("other"))
    met = outline.join(near, ["grp", "cell"]).join(other, ["grp", "other_cell"])
    return written(met.filter(once & (apart <= F.col("radius") + F.col("other_radius") + reach)).select("block", "other"), "vectors-pairs")


def near_vectors(vectors: DataFrame, least: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows are compared only when their labels are equal and not null and their vectors have as many components.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. A row without an id
    links with nothing and is kept, with a null component. Equal vectors are linked with one another, also when an id
    repeats. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("vec"))
    usable = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & valid_vector("vec")).filter(F.exists("vec", lambda v: v != 0))
    usable = usable.withColumn("grp", F.concat_ws(" ", F.size("vec").cast("string"), "label"))
    usable = usable.withColumn("same", F.sha2(F.array_join(F.transform("vec", lambda v: (v + 0.0).cast("string")), ","), 256))
    classes = written(usable.groupBy("grp", "same").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vectors-classes")
    dealt, pivots = keyed(classes.select("grp", F.col("first").alias("id"), "copies", "vec"), "unit")
    trees = written(dealt.groupBy("block").applyInPandas(_trees, "block long, grp string, cell int, high double, centre array<double>, radius double, tree binary"), "vectors-trees")
    pairs = block_pairs(trees, pivots, least)
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    mine = trees.select("block", "tree").join(parts, "block", "left").select("block", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("role"), "tree")
    partners = pairs.join(parts, "block").select("block", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), "other").join(trees.select(F.col("block").alias("other"), "tree"), "other").select("block", "part", F.lit(1).alias("role"), "tree")
    work = mine.unionByName(partners).repartition(partitions(spark), "block", "part").sortWithinPartitions("block", "part", "role")
    found = written(work.mapInArrow(_compare(least), "id long, more long, to long"), "vectors-links")
    dropped(dealt, trees, pairs)

    links = found.groupBy("id").agg(F.sum("more").alias("more"))
    joined = written(components(found, "id", "to"), "vectors-components")
    per_class = classes.select("grp", "same", F.col("first").alias("id"), "copies").join(links, "id", "left").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    per_class = written(per_class.select("grp", "same", "copies", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vectors-result")
    dropped(classes, found, joined)
    out = hot_join(usable.select("id", "grp", "same"), per_class, ["grp", "same"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    lone = rows.filter(~F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & valid_vector("vec") & F.exists("vec", lambda v: v != 0), F.lit(False)))
    out = out.unionByName(lone.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
