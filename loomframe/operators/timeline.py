"""Operators on ordered records of a key: runs, running offsets, look-ups by interval and by time, segments and playlists.

Keys partition every window, so a stream's order is the only thing that one task
keeps together; time and space per task follow the largest key's share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def ordered(keys: Names, order: Names):
    return Window.partitionBy(*keys).orderBy(*order)


def run_lengths(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """Runs of equal neighbouring values: keys, run (from 0), value, run_length. The first row of a change starts a run."""
    w = ordered(keys, order)
    change = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    marked = df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("run_length"))


def expanded_runs(df: DataFrame, keys: Names, order: Names, count: str, delta: str) -> DataFrame:
    """A row per sample of runs (count, delta): sample (from 0 in its run), pts (sum of the deltas before)."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    base = df.withColumn("_base", F.coalesce(F.sum(F.col(count) * F.col(delta)).over(w), F.lit(0)))
    return base.filter(F.col(count) > 0).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))).withColumn("pts", F.col("_base") + F.col("sample") * F.col(delta)).drop("_base")


def running_offset(df: DataFrame, keys: Names, order: Names, size: str, name: str = "offset") -> DataFrame:
    """Sum of the sizes before each row of its key."""
    return df.withColumn(name, F.coalesce(F.sum(size).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def sync_list(df: DataFrame, keys: Names, order: Names, is_sync: Column) -> DataFrame:
    """Positions (from 1) of sync rows; none for keys where none or all rows are sync, as the list then says nothing."""
    every = Window.partitionBy(*keys)
    marked = df.withColumn("_sync", is_sync.cast("int")).withColumn("position", F.row_number().over(ordered(keys, order)).cast("long"))
    counted = marked.withColumn("_n", F.count("*").over(every)).withColumn("_s", F.sum("_sync").over(every))
    return counted.filter("_sync = 1 and _s < _n").select(*keys, "position")


def interval_lookup(points: DataFrame, runs: DataFrame, keys: Names, point: str, first: str, after: str) -> DataFrame:
    """Points joined with the run of their key whose [first, after) holds them. The keys are an equi-join; the interval filters within."""
    return points.join(runs, list(keys)).filter((F.col(point) >= F.col(first)) & (F.col(point) < F.col(after)))


def last_before(df: DataFrame, keys: Names, order: Names, value: Column, inclusive: bool = True) -> Column:
    """As-of look-up backwards: the last value that isn't null at or before each row, without a join."""
    return F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))


def segments(df: DataFrame, keys: Names, order: Names, starts: Column) -> DataFrame:
    """Each row with its segment: 0 before the first start, then one more at each start."""
    return df.withColumn("segment", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def keep_last(df: DataFrame, keys: Names, order: Names, n: int) -> DataFrame:
    """A sliding playlist: the last n rows of each key, with media_sequence, the number of rows that went."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= n).drop("_rank")
    gone = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.greatest(F.count("*") - n, F.lit(0)).cast("long").alias("media_sequence"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return kept.join(gone, same).select(*df.columns, "media_sequence")


def evict_to(df: DataFrame, keys: Names, order: Names, n: int) -> DataFrame:
    """The rows that a buffer of n drops: all but the n highest in order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_rank") > n).drop("_rank")


def wrapped(df: DataFrame, keys: Names, order: Names, value: str, modulus: int) -> Column:
    """A counter that wraps at ``modulus`` as one that goes on: each step over half the modulus is taken as a wrap."""
    w = ordered(keys, order)
    step = F.col(value) - F.lag(value).over(w)
    return F.when(step < -(modulus // 2), modulus).when(step > modulus // 2, -modulus).otherwise(0)


def paired(df: DataFrame, keys: Names, order: Names, same: Column, parity: Column) -> DataFrame:
    """First rows of neighbours that are equal in ``same`` and differ in parity, with partner rows' columns behind ``mate_``."""
    w = ordered(keys, order)
    marked = df.withColumn("_same", same).withColumn("_parity", parity)
    for c in ("_same", "_parity", *order):
        marked = marked.withColumn(f"mate_{c.lstrip('_')}", F.lead(c).over(w))
    return marked.filter((F.col("_same") == F.col("mate_same")) & (F.col("_parity") != F.col("mate_parity"))).drop("_same", "_parity", "mate_same", "mate_parity")


def reference_list(df: DataFrame, keys: Names, ranks: Sequence[Column], n: int, pad: bool = True) -> DataFrame:
    """The first n rows of each key in the given order as slots from 0; ``pad`` fills the rest with the last one."""
    listed = df.withColumn("slot", (F.row_number().over(Window.partitionBy(*keys).orderBy(*ranks)) - 1).cast("int")).filter(F.col("slot") < n)
    if not pad:
        return listed
    last = Window.partitionBy(*keys)
    ends = listed.withColumn("_last", F.max("slot").over(last))
    again = F.when(F.col("slot") == F.col("_last"), F.sequence(F.col("slot"), F.lit(n - 1))).otherwise(F.array("slot"))
    return ends.withColumn("slot", F.explode(again)).drop("_last")
