"""Comparison metrics, parity groups and transforms over arrays and positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """10 log10(peak^2 / mse); infinite where the error is 0, null where it is."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(peak * peak) / mse) * 10)


def differences(df: DataFrame, keys: Sequence[str], a: Column, b: Column, tolerance: float) -> DataFrame:
    """Per key: mse, within_tol, n_diff, max_abs of two columns of positions that are already joined."""
    gap = F.abs(a - b)
    return df.groupBy(*keys).agg(F.avg((a - b) * (a - b)).alias("mse"), F.bool_and(gap <= tolerance).alias("within_tol"), F.count_if(a != b).alias("n_diff"), F.max(gap).alias("max_abs"))


def xor_parity(df: DataFrame, keys: Sequence[str], symbol: Column) -> DataFrame:
    """A parity symbol for each group, the exclusive or of its symbols."""
    return df.groupBy(*keys).agg(F.bit_xor(symbol).alias("parity"), F.count("*").alias("n_symbols"))


def xor_recover(sent: DataFrame, received: DataFrame, keys: Sequence[str], index: str, symbol: str) -> DataFrame:
    """Symbols that weren't received, where a group lacks just one: the parity and the others give it. Groups that lack more have no row."""
    parity = sent.groupBy(*keys).agg(F.bit_xor(symbol).alias("_parity"))
    had = received.groupBy(*keys).agg(F.bit_xor(symbol).alias("_had"))
    lost = sent.select(*keys, index).join(received.select(index), index, "left_anti")
    single = lost.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(index).alias(index)).filter("_n = 1")
    return single.join(parity, list(keys)).join(had, list(keys), "left").select(*keys, index, F.col("_parity").bitwiseXOR(F.coalesce("_had", F.lit(0).cast("long"))).alias("recovered"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def hadamard4(x: Sequence[Column]) -> list[Column]:
    """Four-point Hadamard transform; twice over gives 4x."""
    a, b, c, d = x
    return [a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d]


def nearest_source(target: Column, source_size: Column | int, target_size: Column | int) -> Column:
    """Nearest-neighbour scaling: the source index of a target index."""
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.floor(target * lit(source_size) / lit(target_size)).cast("long")


def plane_place(position: Column, width: int, height: int) -> Column:
    """(plane, y, x) of a position in a picture of one full plane and two of half size, rounded up."""
    half_width, luma = (width + 1) // 2, width * height
    chroma = half_width * ((height + 1) // 2)
    rest = position - luma
    full = F.struct(F.lit(0).cast("long").alias("plane"), F.floor(position / width).alias("y"), (position % width).alias("x"))
    part = F.struct((1 + F.floor(rest / chroma)).alias("plane"), F.floor(rest % chroma / half_width).alias("y"), (rest % chroma % half_width).alias("x"))
    return F.when(position < luma, full).otherwise(part)


def plane_position(plane: Column, y: Column, x: Column, width: int, height: int) -> Column:
    """The position of a sample, back from ``plane_place``."""
    half_width = (width + 1) // 2
    chroma = half_width * ((height + 1) // 2)
    return F.when(plane == 0, y * width + x).otherwise(width * height + (plane - 1) * chroma + y * half_width + x)


def compared(a: DataFrame, b: DataFrame, keys: Sequence[str], position: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Per key of ``a``: psnr, within_tol, n_diff, max_abs against ``b``; samples that only one of them has make these null, false, 0 and null."""
    x, y = F.col("_a"), F.col("_b")
    joined = a.select(*keys, *position, F.col(value).alias("_a")).join(b.select(*keys, *position, F.col(value).alias("_b")), [*keys, *position], "full")
    gap = F.abs(x - y)
    seen = joined.groupBy(*keys).agg(F.count_if(x.isNull() | y.isNull()).alias("_lacks"), F.avg(gap * gap).alias("_mse"), F.bool_and(gap <= tolerance).alias("_within"), F.count_if(x != y).alias("_diff"), F.max(gap).alias("_max"), F.count("_a").alias("_n"))
    whole = F.col("_lacks") == 0
    return seen.filter("_n > 0").select(*keys, F.when(whole, psnr(F.col("_mse"))).alias("psnr"), (whole & F.col("_within")).alias("within_tol"), F.when(whole, F.col("_diff")).otherwise(F.lit(0).cast("long")).alias("n_diff"), F.when(whole, F.col("_max")).alias("max_abs"))


def first_mismatches(a: DataFrame, b: DataFrame, position: str, value: str, n: int) -> DataFrame:
    """The first n positions at which two tables differ, one that only one of them has too."""
    joined = a.select(position, F.col(value).alias("left")).join(b.select(position, F.col(value).alias("right")), position, "full")
    return joined.filter(~F.col("left").eqNullSafe(F.col("right"))).orderBy(position).limit(n)


def same_length(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """Positions at which two tables differ; another number of rows is an error."""
    n, m = (x.agg(F.count("*").alias("_n")) for x in (a, b))
    checked = n.crossJoin(F.broadcast(m.withColumnRenamed("_n", "_m"))).select(F.when(F.col("_n") == F.col("_m"), F.lit(True)).otherwise(F.raise_error(F.lit("tables of different length")).cast("boolean")).alias("_same"))
    joined = a.select(position, F.col(value).alias("left")).join(b.select(position, F.col(value).alias("right")), position, "full")
    return joined.crossJoin(F.broadcast(checked)).filter(F.col("_same") & ~F.col("left").eqNullSafe(F.col("right"))).drop("_same")


def stereo(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, middle: Column, place: Column) -> DataFrame:
    """Channel pairs by line: half sum and half difference where ``middle``; else, where ``place`` isn't null, the right one from the left by 2^(-place/4), turned over below 0."""
    pairs = left.withColumnRenamed(value, "l").join(right.select(*keys, F.col(value).alias("r")), list(keys))
    factor = F.pow(F.lit(2.0), place * -0.25) * F.when(place < 0, -1.0).otherwise(1.0)
    return pairs.withColumns({"l": F.when(middle, (F.col("l") + F.col("r")) * 0.5).otherwise(F.col("l")), "r": F.when(middle, (F.col("l") - F.col("r")) * 0.5).when(place.isNotNull(), F.col("l") * factor).otherwise(F.col("r"))})


def residual_error(df: DataFrame, keys: Sequence[str], value: Column, predicted: Column) -> DataFrame:
    """The sum of squared differences of each block."""
    return df.groupBy(*keys).agg(F.sum((value - predicted) * (value - predicted)).alias("sse"))


def _directions(i: Column, j: Column) -> list[Column]:
    """The line that a sample is on, for each direction."""
    half = lambda v: F.floor(v / 2).cast("long")
    return [i + j, i + half(j), i, i - half(j) + 3, i - j + 7, j - half(i) + 3, j, half(i) + j]


def edge_directions(df: DataFrame, block: str, i: str, j: str, v: str) -> DataFrame:
    """The direction (0 to 7) along which each block of 8 x 8 bytes varies least, and by how much: (block, direction, variance).

    For each direction the samples of each line are summed; the squares, by 840 over the line's samples, add up to
    its cost. The greatest cost wins, the first on ties; variance is its lead over the direction across, over 1024.
    Other than whole blocks give no row.
    """
    whole = df.groupBy(block).agg(F.count("*").alias("_n")).filter("_n = 64").select(block)
    sums = df.join(whole, block, "left_semi").select(block, (F.col(v) - 128).alias("_v"), F.posexplode(F.array(*_directions(F.col(i), F.col(j)))).alias("direction", "_line"))
    sums = sums.groupBy(block, "direction", "_line").agg(F.sum("_v").alias("_s"), F.count("*").alias("_k"))
    costs = sums.groupBy(block, "direction").agg(F.sum(F.col("_s") * F.col("_s") * F.floor(F.lit(840) / F.col("_k"))).alias("_cost"))
    best = costs.groupBy(block).agg(F.max_by("direction", F.struct("_cost", -F.col("direction"))).alias("direction"), F.max("_cost").alias("_best"), F.map_from_entries(F.collect_list(F.struct("direction", "_cost"))).alias("_all"))
    return best.select(block, "direction", F.shiftright(F.col("_best") - F.try_element_at("_all", (F.col("direction") + 4) % 8), 10).alias("variance"))


def linear(df: DataFrame, keys: Sequence[str], index: str, value: str, matrix: DataFrame) -> DataFrame:
    """A linear map of each key's values: ``matrix`` has rows (index, out, weight), a table of its own size, whatever the data."""
    return df.join(F.broadcast(matrix), index).groupBy(*keys, "out").agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def inverse_cosines(spark, n: int) -> DataFrame:
    """The matrix from n coefficients to 2n windowless samples, of which halves of neighbours overlap."""
    k, out = F.col("id") % n, F.floor(F.col("id") / n)
    return spark.range(2 * n * n).select(k.alias("k"), out.alias("out"), (F.cos((out * 2 + 1 + n // 2) * (k * 2 + 1) * (math.pi / (2 * n))) / n).alias("weight"))


def sine_window(i: Column, n: int) -> Column:
    return F.sin((i + 0.5) * (math.pi / n))


def bessel_window(spark, n: int, alpha: float) -> DataFrame:
    """(i, w) of a window of n samples: the root of the running share of a Bessel kernel over its first half, then mirrored."""
    half, step = n // 2, alpha * math.pi / n
    x = (F.col("id") + 0.5) * step
    term = lambda s, k: F.struct((s["term"] * x * x / 4 / (k * k)).alias("term"), (s["sum"] + s["term"] * x * x / 4 / (k * k)).alias("sum"))
    kernel = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), term, lambda s: s["sum"])
    rising = spark.range(half).select("id", kernel.alias("kernel"))
    share = rising.agg(F.array_sort(F.collect_list(F.struct("id", "kernel"))).alias("all")).select(F.posexplode("all").alias("i", "x"), "all")
    upto = F.aggregate(F.slice("all", 1, F.col("i") + 1), F.lit(0.0), lambda s, r: s + r["kernel"])
    total = F.aggregate("all", F.lit(0.0), lambda s, r: s + r["kernel"])
    first = share.select(F.col("i").cast("long").alias("i"), F.sqrt(upto / total).alias("w"))
    return first.unionByName(first.select((F.lit(n - 1) - F.col("i")).alias("i"), "w"))


def inverse_four(w: Sequence[Column]) -> list[Column]:
    """The integer inverse transform of four values; over rows, then columns, it inverts a 4 x 4 block up to a factor of 64."""
    a, b = w[0] + w[2], w[0] - w[2]
    c, d = F.shiftright(w[1], 1) - w[3], w[1] + F.shiftright(w[3], 1)
    return [a + d, b + c, b - c, a - d]


def inverse_four_square(w: Sequence[Column]) -> list[Column]:
    """A 4 x 4 block, rounded by its factor of 64."""
    rows = [x for r in range(4) for x in inverse_four(w[4 * r : 4 * r + 4])]
    columns = [inverse_four(rows[c::4]) for c in range(4)]
    return [F.shiftright(columns[c][r] + 32, 6) for r in range(4) for c in range(4)]


def blended(base: DataFrame, basis: DataFrame, weights: DataFrame, key: str, component: str, position: str, value: str) -> DataFrame:
    """Per key and position: the base and each component by the key's weight. Base and basis are models, of a size of their own."""
    shift = weights.join(F.broadcast(basis), component).groupBy(key, position).agg(F.sum(F.col("weight") * F.col(value)).alias("_shift"))
    return shift.join(F.broadcast(base), position).select(key, position, (F.col(value) + F.col("_shift")).alias(value))


def scaled_planes(df: DataFrame, frame: str, value: str, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Frames (frame, plane, y, x, value) to another size, each plane by its nearest sample; chroma planes have half sizes, rounded up."""
    halves = lambda n: ((n + 1) // 2)
    (w, h), (tw, th) = size, target
    grid = [(p, y, x, y * (h if p == 0 else halves(h)) // (th if p == 0 else halves(th)), x * (w if p == 0 else halves(w)) // (tw if p == 0 else halves(tw))) for p in range(3) for y in range(th if p == 0 else halves(th)) for x in range(tw if p == 0 else halves(tw))]
    places = df.sparkSession.createDataFrame(grid, "plane long, ty long, tx long, y long, x long")
    return df.join(F.broadcast(places), ["plane", "y", "x"]).select(frame, "plane", F.col("ty").alias("y"), F.col("tx").alias("x"), value)


def strictly_recovered(sent: DataFrame, received: DataFrame, keys: Sequence[str], index: str, symbol: str) -> DataFrame:
    """``xor_recover`` for whole groups: one that lacks two symbols or more is an error."""
    lost = sent.select(*keys, index).join(received.select(index), index, "left_anti").groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.lit("a group lacks more than its parity can give")).cast("boolean")).otherwise(F.lit(True))
    return xor_recover(sent, received, keys, index, symbol).join(lost.withColumn("_good", bad), list(keys), "right").filter("_good").drop("_n", "_good")


def concealed(current: DataFrame, previous: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each slot's value, or that of the frame before; frames with different numbers of slots are an error."""
    both = current.select(*keys, F.col(value).alias("_now"), F.lit(1).alias("_c")).join(previous.select(*keys, F.col(value).alias("_old"), F.lit(1).alias("_p")), list(keys), "full")
    even = F.when(F.col("_c").isNull() | F.col("_p").isNull(), F.raise_error(F.lit("frames with different numbers of slots")).cast("boolean")).otherwise(F.lit(True))
    return both.withColumn("_even", even).filter("_even").select(*keys, F.coalesce("_now", "_old").alias(value))


def with_neighbours(df: DataFrame, x: str, y: str, v: str) -> DataFrame:
    """Samples of a grid with left, up and corner, null beyond its ends; a row's or a column's samples are one task's."""
    row, column = Window.partitionBy(y).orderBy(x), Window.partitionBy(x).orderBy(y)
    return df.withColumn("left", F.lag(v).over(row)).withColumn("up", F.lag(v).over(column)).withColumn("corner", F.lag("up").over(row))


def row_taps(df: DataFrame, x: str, y: str, v: str, before: int, after: int) -> DataFrame:
    """Samples with their row's neighbours, tap0 (``before`` to the left) and so on; beyond the ends the last sample goes on."""
    w = Window.partitionBy(y).orderBy(x)
    nearest = lambda f, n: F.coalesce(*[f(v, k).over(w) for k in range(n, 0, -1)], F.col(v))
    taps = {f"tap{before - n}": nearest(F.lag, n) for n in range(before, 0, -1)} | {f"tap{before}": F.col(v)} | {f"tap{before + n}": nearest(F.lead, n) for n in range(1, after + 1)}
    return df.withColumns(taps)


def border_means(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Rounded mean (bx, by, dc) of the samples above and to the left of each n x n block that has all of them; ``df`` is that of ``with_neighbours``."""
    top, side = F.when(F.col(y) % n == 0, F.col("up")), F.when(F.col(x) % n == 0, F.col("left"))
    sums = df.groupBy(F.floor(F.col(x) / n).alias("bx"), F.floor(F.col(y) / n).alias("by")).agg(F.count("*").alias("_n"), F.count(top).alias("_t"), F.count(side).alias("_s"), (F.coalesce(F.sum(top), F.lit(0)) + F.coalesce(F.sum(side), F.lit(0))).alias("_sum"))
    return sums.filter((F.col("_n") == n * n) & (F.col("_t") == n) & (F.col("_s") == n)).select("bx", "by", F.floor((F.col("_sum") + n) / (2 * n)).alias("dc"))


def overlapped(time: DataFrame, keys: Sequence[str], block: str, out: str, v: str, n: int) -> DataFrame:
    """The first halves of blocks of 2n samples under a rising sine window, plus the falling second halves of the blocks before."""
    falling = time.filter(F.col(out) >= n).select(*keys, (F.col(block) + 1).alias(block), (F.col(out) - n).alias(out), (F.col(v) * sine_window(F.lit(2 * n - 1) - F.col(out), 2 * n)).alias("_fall"))
    rising = time.filter(F.col(out) < n).withColumn(v, F.col(v) * sine_window(F.col(out), 2 * n))
    return rising.join(falling, [*keys, block, out], "left").withColumn(v, F.col(v) + F.coalesce("_fall", F.lit(0.0))).drop("_fall")


def scaled_grid(df: DataFrame, x: str, y: str, width: int, target_width: int, num: int, den: int) -> DataFrame:
    """A grid's nearest samples at (tx, ty): ``target_width`` columns, and num/den of its rows, at least one."""
    rows = df.agg((F.max(y) + 1).alias("_h")).withColumn("_th", F.greatest(F.floor(F.col("_h") * num / den), F.lit(1)))
    target = rows.filter("_h is not null").select("_h", "_th", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_th") - 1)).alias("ty"))
    target = target.select("_h", "_th", "ty", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target_width - 1).cast("long"))).alias("tx"))
    source = target.select("tx", "ty", nearest_source(F.col("tx"), width, target_width).alias(x), nearest_source(F.col("ty"), F.col("_h"), F.col("_th")).alias(y))
    return source.join(df, [x, y])
