import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import media as M
from loomframe.operators import graph as G
from loomframe.operators import kernels as K
from loomframe.operators import signal as S
from loomframe.operators import timeline as T
from loomframe.plans.pipeline import Pipeline


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rescale_cuts_towards_zero_and_knows_no_bad_base(spark):
    assert value(spark, M.rescale(F.lit(-7), 1, 2, 1, 1)) == -3
    assert value(spark, M.rescale(F.lit(2**62), 1, 90_000, 1, 90_000)) == 2**62
    assert value(spark, M.rescale(F.lit(5), 1, 0, 1, 1)) is None and value(spark, M.rescale(F.lit(None).cast("long"), 1, 1, 1, 1)) is None


def test_zigzag_is_reversible(spark):
    rows = spark.range(-50, 50).select("id", M.zigzag(F.col("id")).alias("z")).select("id", "z", M.unzigzag(F.col("z")).alias("b")).collect()
    assert all(r.id == r.b and r.z >= 0 for r in rows) and len({r.z for r in rows}) == 100


def test_runs_expand_to_what_they_were(spark):
    rng = random.Random(1)
    rows = [(k // 50, k, rng.choice("ab")) for k in range(200)]
    runs = T.run_lengths(spark.createDataFrame(rows, "key long, at long, v string"), ["key"], ["at"], "v").orderBy("key", "run").collect()
    assert [(r.key, r.v) for r in runs for _ in range(r.run_length)] == [(k, v) for k, _, v in rows]


def test_playlist_slides(spark):
    df = spark.range(5).select(F.lit(1).alias("stream"), F.col("id").alias("index"))
    rows = T.keep_last(df, ["stream"], ["index"], 3).collect()
    assert sorted(r["index"] for r in rows) == [2, 3, 4] and {r.media_sequence for r in rows} == {2}


def test_sync_list_says_nothing_of_all_or_none(spark):
    df = spark.createDataFrame([(1, k, True) for k in range(3)] + [(2, k, False) for k in range(3)] + [(3, k, k != 1) for k in range(3)], "s long, at long, key boolean")
    assert [(r.s, r.position) for r in T.sync_list(df, ["s"], ["at"], F.col("key")).orderBy("position").collect()] == [(3, 1), (3, 3)]


def test_levels_leave_cycles_out(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 4), (3, 4), (5, 6), (6, 5), (6, 7), (8, 8)], "src long, dst long")
    nodes = spark.range(0, 9)
    assert {r.id: r.level for r in G.levels(nodes, edges).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_lost_symbols_come_back(spark):
    rows = [(k % 4, k, (k * 2654435761) % 2**32) for k in range(40)]
    sent = spark.createDataFrame(rows, "g long, i long, s long")
    got = {r.i: r.recovered for r in S.xor_recover(sent, sent.filter("i not in (5, 10, 14)"), ["g"], "i", "s").collect()}
    assert got == {5: rows[5][2]}


def test_psnr_of_equal_frames_is_infinite(spark):
    assert value(spark, S.psnr(F.lit(0.0))) == float("inf") and value(spark, S.psnr(F.lit(65025.0))) == 0.0


def test_hadamard_twice_is_four_times(spark):
    once = S.hadamard4([F.lit(x) for x in (3, -1, 4, 1)])
    assert [value(spark, c) for c in S.hadamard4(once)] == [12, -4, 16, 4]


def test_lift_inverse_undoes_the_predictor(spark):
    values = [5, 7, -2, 9, 4, 4, 100, -50]
    residuals = []
    for k, v in enumerate(values):
        last = values[max(0, k - 3) : k]
        residuals.append(v - (int(sum(last) / len(last)) if last else 0))
    assert value(spark, K.lift_inverse(F.array(*[F.lit(r).cast("long") for r in residuals]))) == values


def test_reference_buffer_slides_and_clears(spark):
    rows = [(1, 0, 0, True, True), (1, 1, 1, False, True), (1, 2, 2, False, True), (1, 3, 2, False, True), (1, 4, 3, False, False), (1, 5, 15, False, True), (1, 6, 0, True, True)]
    got = {r.seq: r.held for r in K.reference_buffers(spark.createDataFrame(rows, "stream long, seq long, frame_num long, is_idr boolean, is_ref boolean"), 2).collect()}
    assert got == {0: [0], 1: [1, 0], 2: [2, 1], 3: [2, 1], 4: [2, 1], 5: [15, 2], 6: [0]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_range_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    data = bytes(rng.geometric(0.1, 5000).clip(0, 255).astype(np.uint8))
    freq = K.frequencies(np.bincount(np.frombuffer(data, np.uint8), minlength=256))
    code = K.rans_encode(data, freq)
    assert freq.sum() == 4096 and K.rans_decode(code, len(data), freq) == data and len(code) < len(data)


def test_planes_round_trip(spark):
    rng = np.random.default_rng(4)
    planes = [(1, 16, bytes(np.cumsum(rng.integers(-2, 3, 256)).astype(np.uint8))), (2, 7, bytes(rng.integers(0, 256, 7 * 5 + 3, dtype=np.uint8))), (3, 4, b""), (4, 1, b"\x05\x09")]
    df = spark.createDataFrame(planes, "id long, width int, data binary")
    assert {r.id: bytes(r.data) for r in K.decoded_planes(K.coded_planes(df)).collect()} == {i: d for i, _, d in planes}


def test_pipeline_is_composition(spark):
    chain = Pipeline().add(lambda d: d.filter("id > 2")).add(lambda d: d.withColumn("x", F.col("id") * 2))
    assert [r.x for r in chain.run(spark.range(5)).collect()] == [6, 8] and Pipeline().run(spark.range(2)).count() == 2


def test_identifiers(spark):
    for raw, want in {"state-a": "State_a", "ok": "Ok", "__": "State___"}.items():
        assert value(spark, M.identifier(F.lit(raw))) == want


def test_positions_evaluate_their_key_once(spark):
    keys = [None, float("-inf"), -1.0, 0.0, 0.5, 1.0, 7.0, 15.0, 15.5, 16.0, 31.0, 32.0, 254.0, 300.0, float("inf"), float("nan")]
    rows = spark.createDataFrame([(k,) for k in keys], "k double")
    for n in (0, 1, 15, 16, 17, 32, 255):
        bounds = [float(b) for b in range(n)]
        got = [r.n for r in rows.select(G.bounds_below(bounds, F.col("k")).alias("n")).collect()]
        assert got == [0 if k is None else n if k != k else sum(b < k for b in bounds) for k in keys]
    spread = spark.range(1024).select("id", M.spread_bits(F.col("id")).alias("s"), M.spread_bits(F.col("id") + 1024).alias("t")).collect()
    assert all(r.s == r.t == sum((r.id >> k & 1) << 3 * k for k in range(10)) for r in spread)
    # the key stands in the plan a few times, not once a bound or once a step of the spread
    plan = G.positions(spark.range(1000).select(M.morton(*[F.col("id") + k for k in (0, 1, 2)]).alias("m"), "id"), "m", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("id#") < 60
