"""Vectors dealt to blocks around pivots: the common ground of near-duplicate search and top-k search.

Rows of one group (a label, a dimension) are keyed by their nearest pivot and
their distance to it. Distances are cut at quantiles to rings, and rings that are
still too full, as many rows may have the same distance, by a hash; so a block has
about ``BLOCK`` rows whatever the group's size. Pivots are a sample of at most
``PIVOTS`` rows; every row is keyed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.shared import dropped, hot_join, written

BLOCK = 1024
PIVOTS = 2048
RINGS = 64


def valid_vector(column: str) -> Column:
    """True for arrays without null or non-finite components; false for null and empty ones."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad, F.lit(False))


def pivots(rows: DataFrame) -> dict[str, np.ndarray]:
    """For each group of more than ``BLOCK`` rows, one pivot per half ``BLOCK`` rows, but at most ``PIVOTS`` in all.

    The sample is drawn by a hash of the id, as large a share of every group, and is all that comes to the driver.
    """
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not total:
        return {}
    share = min(PIVOTS, total / (BLOCK / 2)) / total
    drawn = rows.join(sizes.select("grp"), "grp", "left_semi").filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) < int(2 * share * (1 << 40)) + 1)
    drawn = drawn.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(PIVOTS).select("grp", "vec").collect()
    out: dict[str, list] = {}
    for x in drawn:
        out.setdefault(x["grp"], []).append(x["vec"])
    return {g: np.unique(np.array(v, np.float64), axis=0) for g, v in out.items()}


def keyed(rows: DataFrame, scale: str = "none") -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Rows (grp, id, copies, vec: array of double) with cell, dist (to the cell's pivot) and block; and the pivots.

    ``scale`` is "unit" to measure between unit vectors. A group without pivots has one cell, measured from its own zero.
    """
    found = pivots(rows)
    unit = scale == "unit"
    if unit:
        found = {g: p / np.linalg.norm(p, axis=1, keepdims=True) for g, p in found.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_pylist()
            cell, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            vectors = batch.column("vec")
            flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            by_group: dict[str, list[int]] = {}
            for k, g in enumerate(groups):
                by_group.setdefault(g, []).append(k)
            for g, where in by_group.items():
                dim = int(offsets[where[0] + 1] - offsets[where[0]])
                x = flat[offsets[where][:, None] + np.arange(dim)]
                if unit:
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                p = found.get(g, np.zeros((1, dim)))
                square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T
                nearest = square.argmin(axis=1)
                cell[where] = nearest
                dist[where] = np.sqrt(((x - p[nearest]) ** 2).sum(axis=1))
            yield batch.append_column("cell", pa.array(cell)).append_column("dist", pa.array(dist))

    dealt = written(rows.select("grp", "id", "copies", "vec").mapInArrow(assign, "grp string, id long, copies long, vec array<double>, cell int, dist double"), "vectors-dealt")
    cuts = dealt.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", [k / RINGS for k in range(1, RINGS)], 1000).alias("cuts")).filter(F.col("n") > BLOCK)
    step = F.greatest(F.lit(1), F.floor(RINGS * BLOCK / F.col("n"))).cast("int")
    passed = F.size(F.filter("cuts", lambda c: c < F.col("dist")))
    ring = F.coalesce(F.floor(passed / step), F.lit(0)).cast("int")
    # groups over BLOCK rows have pivots, so besides these few groups there are no cuts
    joined = dealt.join(F.broadcast(cuts) if cuts.count() <= 2 * PIVOTS else cuts, ["grp", "cell"], "left")
    ringed = written(joined.select("grp", "id", "copies", "vec", "cell", "dist", ring.alias("ring")), "vectors-ringed")
    full = written(ringed.groupBy("grp", "cell", "ring").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > BLOCK), "vectors-full")
    slots = F.coalesce(F.ceil(F.col("crowd") / BLOCK), F.lit(1))
    blocked = hot_join(ringed, full, ["grp", "cell", "ring"], "crowd").withColumn("block", F.xxhash64("grp", "cell", "ring", F.pmod(F.xxhash64("id"), slots)))
    blocked = written(blocked.select("grp", "id", "copies", "vec", "cell", "dist", "block"), "vectors-blocked")
    dropped(dealt, ringed, full)
    return blocked, found
