"""Exact top-k search by integer inner product through a pivot-distance index.

Every row is keyed by its nearest pivot and its distance to it, sorted by that
distance within blocks. For a query q, a pivot p and a row y with
lo <= d(y, p) <= hi, the triangle inequality gives d(q, y) >= max(d(q, p) - hi,
lo - d(q, p), 0), and as q.y = (|q|^2 + |y|^2 - d(q, y)^2) / 2, an annulus around
p can be left out once its bound is under the k-th best score known. Blocks of
near cells make a region, of which one task holds the rows; the first such score
comes from each query's own region. The same bound over the cells of the other
regions leaves those that a query is sent to, once for all their blocks; there
blocks are searched nearest first, and rows from the annulus nearest to d(q, p)
outwards until the bound stops it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.shared import dropped, partitions, written
from loomframe.llm.vectors import keyed, valid_vector

#: Queries to a region that one task answers, and those that are searched together.
QUERIES, TOGETHER = 1 << 16, 256
#: Rows of an annulus that are scored at a time, to each side.
STEP = 512
#: Bytes of a region's rows, as doubles, at most; and regions that small tables are cut to, which bounds how often queries are sent.
REGION_BYTES, REGIONS = 64 << 20, 48


def packed(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest of three types, which their bytes a component tell."""
    most = np.abs(x).max(initial=0)
    return x.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8")


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<f8"}[len(data) // n]).astype(np.float64)


def _scores(rows: np.ndarray, queries: np.ndarray, reach: float) -> np.ndarray:
    """Exact integer inner products, rows by queries: in floating point while ``reach``, which no sum of absolute products exceeds, allows."""
    kind = np.float32 if reach < 0.99 * 2**24 else np.float64 if reach < 0.99 * 2**53 else np.int64
    return rows.astype(kind) @ queries.astype(kind).T


def _blocks(found: dict[str, np.ndarray], places: dict[tuple[str, int], tuple[int, int]]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["dist", "id"])
        x, grp = np.stack(group["vec"].to_numpy()).astype(np.float64), group["grp"].iloc[0]
        pivot = found[grp][group["cell"].iloc[0]] if grp in found else np.zeros(x.shape[1])
        norm = float((x * x).sum(axis=1).max())
        blob = pickle.dumps((group["id"].to_numpy(), packed(x), group["dist"].to_numpy(), pivot, norm))
        region = _region(places, grp, group["cell"].iloc[0], group["block"].iloc[0])
        return pd.DataFrame({"block": [group["block"].iloc[0]], "grp": [grp], "cell": [group["cell"].iloc[0]], "region": [region], "low": [group["dist"].iloc[0]], "high": [group["dist"].iloc[-1]], "norm": [norm], "rows": [blob]})

    return run


def _widths(square: np.ndarray, norm: np.ndarray | float, floor: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The largest distance at which a row of that norm can still reach the floor; negative if none can. ``own``: distances it is compared with."""
    room = square + norm - 2 * floor + 1e-12 * (square + norm)
    return np.where(room >= 0, np.sqrt(np.maximum(room, 0)) * (1 + 1e-9) + 1e-9 * own + 1e-6, -1.0)


class Best:
    """The k best rows of each of some queries among scores >= their floors: ``at`` (the query's place), ``ids`` and ``scores``, in order."""

    def __init__(self, query_ids: np.ndarray, floors: np.ndarray, k: int):
        self.query_ids, self.k, self.more, self.n_more = query_ids, k, [], 0
        self.floors, self.last = floors.astype(np.float64), np.full(len(floors), np.iinfo(np.int64).max)
        self.at, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        i, j = np.nonzero(scores >= self.floors[who].astype(scores.dtype if scores.dtype.kind == "f" else np.float64))
        at, ids, scores = who[j], ids[i], scores[i, j].astype(np.int64)
        keep = (ids != self.query_ids[at]) & ((scores > self.floors[at]) | (ids <= self.last[at]))
        self.more.append((at[keep], ids[keep], scores[keep]))
        self.n_more += int(keep.sum())
        if self.n_more >= len(self.floors):
            self.settle()

    def settle(self) -> None:
        """Of equal scores the smaller id is better; floors rise to the k-th best score, rounded down."""
        at, ids, scores = (np.concatenate(x) for x in zip((self.at, self.ids, self.scores), *self.more))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        self.at, self.ids, self.scores = at[rank < self.k], ids[rank < self.k], scores[rank < self.k]
        full = rank == self.k - 1
        floors = scores[full].astype(np.float64)
        self.floors[at[full]] = np.maximum(self.floors[at[full]], np.where(floors.astype(np.int64) > scores[full], np.nextafter(floors, -np.inf), floors))
        self.last[at[full]] = np.where(np.abs(floors) < 2**53, ids[full], np.iinfo(np.int64).max)
        self.more, self.n_more = [], 0


def search(blocks: list[tuple], query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> Best:
    """The best k of the blocks' rows for each query (a row of ``q``) among scores >= its floor, rows of its own id left out."""
    out, square = Best(query_ids, floors, k), (q * q).sum(axis=1)
    owns = [np.sqrt(((q - pivot) ** 2).sum(axis=1)) for _, _, _, pivot, _ in blocks]
    gaps = [np.maximum(np.maximum(own - dist[-1], dist[0] - own), 0).mean() for own, (_, _, dist, _, _) in zip(owns, blocks)]
    for n in np.argsort(gaps, kind="stable"):
        (ids, x, dist, _, norm), own = blocks[n], owns[n]
        reach = float(np.sqrt(norm) * np.sqrt(square.max()))
        low = high = int(np.searchsorted(dist, np.median(own)))
        while low > 0 or high < len(ids):
            width = _widths(square, norm, out.floors, own)
            first, last = np.searchsorted(dist, own - width), np.searchsorted(dist, own + width, "right")
            first[width < 0], last[width < 0] = len(ids), 0
            next_low, next_high = max(int(first.min()), low - STEP), min(int(last.max()), high + STEP)
            parts = [slice(min(next_low, low), low), slice(high, max(next_high, high))]
            if all(p.stop <= p.start for p in parts):
                break
            for p in parts:
                who = np.flatnonzero((first < p.stop) & (last > p.start))
                if p.stop > p.start and len(who):
                    out.add(who, ids[p], _scores(x[p], q[who], reach))
            low, high = min(next_low, low), max(next_high, high)
    out.settle()
    return out


def _search_all(k: int):
    """(region, part, role, query_id, floor, vec, rows): a region's blocks, then its queries; gives each query's best of the region.

    The floor given is the k-th best score found, or what the query came with.
    """

    def answered(region: str, blocks: list[tuple], asked: list[tuple[int, float, bytes]]) -> pa.RecordBatch:
        ids = np.array([a[0] for a in asked], np.int64)
        found = search(blocks, ids, np.stack([unpacked(a[2], blocks[0][1].shape[1]) for a in asked]), np.array([a[1] for a in asked], np.float64), k)
        offsets = np.searchsorted(found.at, np.arange(len(asked) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (found.ids, found.scores)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([region] * len(ids), pa.string()), pa.array(found.floors), pa.array([a[2] for a in asked], pa.binary()), *lists], names=["query_id", "region", "floor", "vec", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, asked = None, [], []
        for batch in batches:
            blobs, vectors = batch.column("rows"), batch.column("vec")
            for n, (region, part, role, query_id, floor) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("region", "part", "role", "query_id", "floor")])):
                if asked and (len(asked) == TOGETHER or now != (region, part)):
                    yield answered(now[0], blocks, asked)
                    asked = []
                if now != (region, part):
                    now, blocks = (region, part), []
                if role == 0:
                    blocks.append(pickle.loads(blobs[n].as_buffer()))
                else:
                    asked.append((query_id, floor, vectors[n].as_py()))
        if asked:
            yield answered(now[0], blocks, asked)

    return run


_ASKED = "query_id long, region string, cell int, own double, floor double, vec binary"
_FOUND = "query_id long, region string, floor double, vec binary, ids array<long>, scores array<long>"


def _answers(asked: DataFrame, blocks: DataFrame, k: int, tasks: int) -> DataFrame:
    """Each (query_id, region, cell, own, floor, vec) asked, with what the region's blocks answer. Only counts of regions are broadcast."""
    parts = F.broadcast(asked.groupBy("region").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    offered = blocks.join(parts, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "rows")
    sent = asked.join(parts, "region").select("region", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "cell", "own", "query_id", "floor", "vec")
    work = offered.unionByName(sent, allowMissingColumns=True).repartition(tasks, "region", "part")
    return work.sortWithinPartitions("region", "part", "role", "cell", "own", "query_id").mapInArrow(_search_all(k), _FOUND)


def regions(dealt: DataFrame, found: dict[str, np.ndarray], n: int) -> dict[tuple[str, int], tuple[int, int]]:
    """The (first, slices) of each (grp, cell): cells in the order of their pivots dealt to regions; a cell too large for one is cut to slices.

    Only the sizes of the pivots' cells come to the driver, at most as many as pivots.
    """
    cells = dealt.filter(F.col("grp").isin(*found)).groupBy("grp", "cell").agg(F.count("*").alias("n")).collect() if found else []
    share = -(-sum(x["n"] for x in cells) // max(1, min(n, REGIONS)))
    out, at, filled, before = {}, 0, 0, None
    for x in sorted(cells, key=lambda x: (x["grp"], x["cell"])):
        most = max(1, min(share, REGION_BYTES // (8 * found[x["grp"]].shape[1])))
        if filled and (x["grp"] != before or filled + x["n"] > most):
            at, filled = at + 1, 0
        slices, before = -(-x["n"] // most), x["grp"]
        out[x["grp"], x["cell"]] = at, slices
        at, filled = (at + slices, 0) if slices > 1 else (at, filled + x["n"])
    return out


def _region(places: dict[tuple[str, int], tuple[int, int]], grp: str, cell: int, block: int) -> str:
    """A cell's slice is that of the block; a group without pivots is one region."""
    first, slices = places.get((grp, int(cell)), (0, 1))
    return f"{grp}/{first + int(block) % slices}"


def _own_regions(places: dict[tuple[str, int], tuple[int, int]]):
    """Queries (query_id, grp, cell, block, dist, vec) as they are asked in their own region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [_region(places, *key) for key in zip(*[batch.column(c).to_pylist() for c in ("grp", "cell", "block")])]
            vectors = [packed(np.asarray(v, np.float64)).tobytes() for v in batch.column("vec").to_pylist()]
            floors = pa.array([float("-inf")] * len(at), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(at, pa.string()), batch.column("cell"), batch.column("dist"), floors, pa.array(vectors, pa.binary())], names=["query_id", "region", "cell", "own", "floor", "vec"])

    return run


def _near_regions(found: dict[str, np.ndarray], outlines: dict[str, list[tuple[int, str, float, float, float]]]):
    """(query_id, region, floor, vec): each query with the other regions of its group that the bound of a cell leaves, and the nearest such cell's number and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for query_id, own_region, floor, vec in zip(*[batch.column(c).to_pylist() for c in ("query_id", "region", "floor", "vec")]):
                grp = own_region.split("/")[0]
                if grp not in tables:
                    continue
                cells, places, low, high, norm = tables[grp]
                q = unpacked(vec, found[grp].shape[1])
                own = np.sqrt(((found[grp][cells] - q) ** 2).sum(axis=1))
                width = _widths(np.float64(q @ q), norm, np.float64(floor), own)
                left = np.flatnonzero((width >= 0) & (np.maximum(own - high, low - own) <= width) & (places != index[own_region]))
                left = left[np.argsort(own[left], kind="stable")]
                _, nearest = np.unique(places[left], return_index=True)
                out += [(query_id, names[places[c]], int(cells[c]), float(own[c]), floor, vec) for c in left[nearest]]
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    arrow = pa.schema([("query_id", pa.int64()), ("region", pa.string()), ("cell", pa.int32()), ("own", pa.float64()), ("floor", pa.float64()), ("vec", pa.binary())])
    names = sorted({r[1] for rows in outlines.values() for r in rows})
    index = {r: n for n, r in enumerate(names)}
    tables = {g: tuple(map(np.array, zip(*[(c, index[r], low, high, norm) for c, r, low, high, norm in rows]))) for g, rows in outlines.items()}
    return run


def asked_blocks(seeds: DataFrame, blocks: DataFrame, found: dict[str, np.ndarray]) -> DataFrame:
    """(query_id, region, cell, own, floor, vec) wherever the bound of a cell in another region than the query's own reaches its floor: the blocks it asks.

    Only the outlines of the pivots' cells come to the driver, at most as many as pivots and cuts of large cells.
    """
    cells = blocks.filter(F.col("grp").isin(*found)).groupBy("grp", "cell", "region").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).collect() if found else []
    outlines: dict[str, list[tuple[int, str, float, float, float]]] = {}
    for x in sorted(cells, key=lambda x: (x["grp"], x["cell"], x["region"])):
        outlines.setdefault(x["grp"], []).append((x["cell"], x["region"], x["low"], x["high"], x["norm"]))
    return seeds.select("query_id", "region", "floor", "vec").mapInArrow(_near_regions(found, outlines), _ASKED)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, the rows whose id is divisible by ``every``.

    A component x becomes floor(scale * x), with x as double; the score is the integer inner product, exact for
    scaled components under 2^26 in magnitude. Candidates are all rows of as many components but those of the query's
    id; ties go to the smaller id. Rows without an id, and vectors that are null, empty or hold null or non-finite
    components, take no part. A query id that repeats asks once, with the least of its vectors. Fewer candidates
    than k: all of them. Empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & valid_vector("vec"))
    rows = rows.select("id", F.transform("vec", lambda v: F.floor(v * scale).cast("double")).alias("vec"), F.lit(1).cast("long").alias("copies"), F.size("vec").cast("string").alias("grp"))
    dealt, found = keyed(rows)
    n = partitions(spark)
    places = regions(dealt, found, n)
    tasks = max(n, 3 * max((first + slices for first, slices in places.values()), default=0))
    blocks = written(dealt.groupBy("block").applyInPandas(_blocks(found, places), "block long, grp string, cell int, region string, low double, high double, norm double, rows binary"), "topk-blocks")
    queries = dealt.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vec", "block", "grp", "cell", "dist")).alias("q")).select(F.col("id").alias("query_id"), "q.*")
    own = queries.mapInArrow(_own_regions(places), _ASKED)
    seeds = written(_answers(own, blocks, k, tasks), "topk-seeds")
    more = written(_answers(asked_blocks(seeds, blocks, found), blocks, k, tasks).filter(F.size("ids") > 0).select("query_id", "ids", "scores"), "topk-found")
    dropped(dealt, blocks)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    partial = seeds.select("query_id", "ids", "scores").unionByName(more).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    partial = partial.select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
