import random

from pyspark.sql import functions as F

from loomframe.operators import graph as G
from loomframe.operators import references as P


def test_display_order_is_that_of_a_fold(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for stream in range(6):
        last = 0
        for seq in range(80):
            idr = rng.random() < 0.05
            ref = idr or rng.random() < 0.6
            lsb = rng.randrange(16)
            rows.append((stream, seq, lsb, idr, ref))
            last = 0 if idr else last
            low = last % 16
            high = last - low
            high += 16 if lsb < low and low - lsb >= 8 else -16 if lsb > low and lsb - low > 8 else 0
            want[stream, seq] = high + lsb
            last = high + lsb if ref else last
    df = spark.createDataFrame(rows, "s long, seq long, lsb long, idr boolean, ref boolean")
    got = P.display_order(df, ["s"], ["seq"], "lsb", F.col("idr"), F.col("ref"), 16).collect()
    assert {(r.s, r.seq): r.poc for r in got} == want


OPS = "stream long, seq long, frame_num long, is_idr boolean, is_ref boolean, ops array<struct<op:int,n:int,m:int>>"


def held(spark, pictures, most):
    rows = [(1, k, *p) for k, p in enumerate(pictures)]
    got = P.marked_buffers(spark.createDataFrame(rows, OPS), most).orderBy("seq").collect()
    return [(r.short, [(x["index"], x["frame_num"]) for x in r.long], r.failed) for r in got]


def test_buffers_slide_and_are_marked(spark):
    I, R, N = (True, True), (False, True), (False, False)  # noqa: E741
    slide = [(0, *I, None), (1, *R, None), (2, *R, None), (2, *N, None), (3, *R, None), (3, *R, None)]
    assert held(spark, slide, 3) == [([0], [], False), ([0, 1], [], False), ([0, 1, 2], [], False), ([0, 1, 2], [], False), ([1, 2, 3], [], False), ([2, 3], [], False)]
    wrap = [(14, *I, None), (15, *R, None), (0, *R, None), (1, *R, None)]
    assert [x[0] for x in held(spark, wrap, 3)] == [[14], [14, 15], [14, 15, 0], [15, 0, 1]]
    marked = [(0, *I, [(7, 0, 1)]), (1, *R, None), (2, *R, [(3, 0, 1)]), (3, *R, [(1, 0, 0)]), (4, *R, [(4, 1, 0), (6, 0, 0)]), (5, *R, [(2, 7, 0)]), (6, *R, None), (7, *R, [(5, 0, 0)]), (8, *I, None)]
    assert held(spark, marked, 4) == [([], [(0, 0)], False), ([1], [(0, 0)], False), ([2], [(0, 0), (1, 1)], False), ([3], [(0, 0), (1, 1)], False), ([3], [(0, 4)], False), ([], [], True), ([6], [], False), ([0], [], False), ([8], [], False)]


def test_lists_are_modified_in_order(spark):
    df = spark.createDataFrame([([5, 4, 3, 2], [(0, 1), (1, 0)]), ([5, 4, 3, 2], [(0, 8)]), ([5, 4], [])], "init array<long>, steps array<struct<op:int,n:int>>")
    got = [r.m for r in df.select(P.modified(F.col("init"), F.col("steps"), F.lit(6).cast("long"), 16, 3).alias("m")).collect()]
    assert got == [[4, 5, 3], None, [5, 4]]


def test_positions_are_dense(spark):
    rows = [(k % 7 * 1.5, k) for k in range(200)]
    got = G.positions(spark.createDataFrame(rows, "v double, k long").repartition(5), "v", ["k"], buckets=4).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == [k for _, k in sorted(rows)] and sorted(r.position for r in got) == list(range(200))
    assert G.positions(spark.createDataFrame([], "v double, k long"), "v", []).count() == 0


def test_levels_of_long_chains(spark):
    nodes, edges = spark.range(12), spark.range(11).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.id: r.level for r in G.levels(nodes, edges).collect()} == {k: k for k in range(12)}
