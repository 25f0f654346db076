"""Reference pictures: display order, lists and their modification, and the marking of a stream's buffer.

What one picture needs from those before it is a window where that can be said, else an ordered fold over a stream's
pictures between two that restart it; a stream's pictures go to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators import timeline as T

Names = Sequence[str]


def display_order(df: DataFrame, keys: Names, order: Names, lsb: str, is_idr: Column, is_ref: Column, modulus: int, name: str = "poc") -> DataFrame:
    """Display order from a counter that wraps at ``modulus``: only reference pictures move what the next ones count from.

    A picture under the last reference's counter by half the modulus or more is behind a wrap; one over it by more
    is before one. An IDR picture starts from 0.
    """
    parts = [*keys, "_part"]
    before = T.ordered(parts, order).rowsBetween(Window.unboundedPreceding, -1)
    marked = T.segments(df.withColumns({"_idr": is_idr, "_ref": is_ref | is_idr}), keys, order, F.col("_idr")).withColumnRenamed("segment", "_part")
    last = F.coalesce(F.last(F.when(F.col("_ref"), F.col(lsb)), ignorenulls=True).over(before), F.lit(0))
    gap = F.col(lsb) - F.col("_last")
    jump = F.when(-gap >= modulus // 2, modulus).when(gap > modulus // 2, -modulus).otherwise(0).cast("long")
    stepped = marked.withColumn("_last", F.when(F.col("_idr"), F.lit(0)).otherwise(last)).withColumn("_jump", jump)
    # the wraps of the references before add up; a picture's own counts for itself, and for the next if it is one
    moved = F.coalesce(F.sum(F.when(F.col("_ref"), F.col("_jump"))).over(before), F.lit(0).cast("long"))
    return stepped.withColumn(name, moved + F.col("_jump") + F.col(lsb)).drop("_idr", "_ref", "_part", "_last", "_jump")


def coding_order(df: DataFrame, keys: Names, order: Names, frame_num: str, is_idr: Column, bottom: Column, modulus: int, name: str = "poc") -> DataFrame:
    """Display order where it is that of coding: twice the frame number with all wraps since the last IDR, and 1 more for bottom fields."""
    parts = [*keys, "_part"]
    marked = T.segments(df, keys, order, is_idr).withColumnRenamed("segment", "_part")
    wrap = F.when(F.col(frame_num) < F.lag(frame_num).over(T.ordered(parts, order)), modulus).otherwise(0).cast("long")
    wraps = F.sum("_wrap").over(T.ordered(parts, order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_wrap", wrap).withColumn(name, (wraps + F.col(frame_num)) * 2 + F.when(bottom, 1).otherwise(0)).drop("_part", "_wrap")


def picture_number(frame_num: Column, current: Column, modulus: int, field: Column | None = None, bottom: Column | None = None) -> Column:
    """The number by which a short-term picture is asked for: under 0 behind a wrap; fields count twice, bottom ones 1 more."""
    number = F.when(frame_num > current, frame_num - modulus).otherwise(frame_num)
    if field is None:
        return number
    return F.when(field, number * 2 + F.when(bottom, 1).otherwise(0)).otherwise(number)


def by_number(asked: DataFrame, held: DataFrame, keys: Names, number: str, order: str) -> DataFrame:
    """What is asked for, each with the first held picture of its number; others have none and are dropped."""
    first = held.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, number).orderBy(order))).filter("_rank = 1").drop("_rank")
    return asked.join(first, [*keys, number])


def field_ranks(number: Column, long_number: Column, is_long: Column, bottom: Column, current_bottom: Column) -> list[Column]:
    """The order of fields for ``timeline.reference_list``: short-term ones first, of the same parity first, newest first; long-term ones by number."""
    return [is_long, bottom != current_bottom, F.when(is_long, long_number).otherwise(-number)]


def modified(initial: Column, steps: Column, current: Column, modulus: int, n: int) -> Column:
    """A list of picture numbers after its modification; null if a step asks for a number that isn't in the list.

    ``steps`` are structs (op, n): 0 goes n + 1 down and 1 up from the last number asked for, from ``current`` at
    first, modulo ``modulus``; numbers over the current one stand for those behind a wrap. Each picture found is put
    at the next place, and taken out behind it. The list keeps at most ``n``.
    """

    def step(s: Column, op: Column) -> Column:
        moved = F.when(op["op"] == 0, s["last"] - op["n"] - 1).otherwise(s["last"] + op["n"] + 1)
        last = F.pmod(moved, F.lit(modulus))
        number = F.when(last > current, last - modulus).otherwise(last)
        found = F.array_contains(initial, number)
        before, after = F.slice(s["list"], 1, s["at"]), F.slice(s["list"], s["at"] + 1, F.greatest(F.size(s["list"]) - s["at"], F.lit(0)))
        listed = F.concat(before, F.array(number), F.filter(after, lambda x: x != number))
        return F.struct(F.when(found, listed).alias("list"), (s["at"] + 1).alias("at"), last.alias("last"))

    start = F.struct(initial.alias("list"), F.lit(0).alias("at"), current.cast("long").alias("last"))
    return F.aggregate(steps, start, step, lambda s: F.slice(s["list"], 1, n))


MARKS = "stream long, seq long, short array<long>, long array<struct<index:long,frame_num:long>>, failed boolean"


def marked_buffers(pictures: DataFrame, max_refs: int, log2_max: int = 4) -> DataFrame:
    """The reference buffer after each picture (stream, seq, frame_num, is_idr, is_ref, ops): short-term numbers, oldest first, and long-term ones by index.

    ``ops`` is null to slide, else the commands (op, n, m) in order: 1 drops the short-term picture n + 1 before, 2 the
    long-term one of index n, 3 turns the short-term one n + 1 before to index m, 4 keeps indices under n, 5 drops all
    and restarts the numbers, 6 gives the current picture index n. For an IDR, (7, _, 1) makes it long-term 0. A
    command whose picture isn't there empties the buffer and sets ``failed``. A picture takes the place of a
    short-term one of its number.
    """
    modulus, room = 1 << log2_max, max(1, max_refs)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        short: list[int] = []
        long: dict[int, int] = {}
        rows = []

        def number(frame: int, current: int) -> int:
            return frame - modulus if frame > current else frame

        def slide(current: int, most: int) -> None:
            while len(short) + len(long) > most:
                if short:
                    short.remove(min(short, key=lambda x: number(x, current)))
                else:
                    del long[next(iter(long))]

        for stream, seq, frame, idr, ref, ops in group.sort_values("seq")[["stream", "seq", "frame_num", "is_idr", "is_ref", "ops"]].itertuples(index=False):
            failed, as_long = False, None
            steps = [] if ops is None else [(o["op"], o["n"], o["m"]) for o in ops]
            if idr:
                short, long = [], {}
                as_long = 0 if any(op == 7 and m for op, _, m in steps) else None
            elif ref and ops is None:
                slide(frame, room - 1)
            elif ref:
                for op, n, m in steps:
                    held = next((x for x in short if number(x, frame) == frame - n - 1), None) if op in (1, 3) else None
                    if op in (1, 3) and held is None or op == 2 and n not in long:
                        failed = True
                        break
                    if op == 1:
                        short.remove(held)
                    elif op == 2:
                        del long[n]
                    elif op == 3:
                        short.remove(held)
                        long.pop(m, None)
                        long[m] = held
                    elif op == 4:
                        long = {k: v for k, v in long.items() if k < n}
                    elif op == 5:
                        short, long, frame = [], {}, 0
                    elif op == 6:
                        long.pop(n, None)
                        as_long = n
            if failed:
                short, long = [], {}
            elif ref or idr:
                short = [x for x in short if x != frame]
                if as_long is None:
                    short.append(frame)
                else:
                    long[as_long] = frame
                slide(frame, room)
            rows.append((stream, seq, list(short), [{"index": k, "frame_num": v} for k, v in sorted(long.items())], failed))
        return pd.DataFrame(rows, columns=["stream", "seq", "short", "long", "failed"])

    return pictures.groupBy("stream").applyInPandas(fold, MARKS)


def counts(held: DataFrame, keys: Names) -> DataFrame:
    """Short-term and long-term pictures of each buffer."""
    return held.groupBy(*keys).agg(F.count_if(~F.col("is_long")).alias("n_short"), F.count_if("is_long").alias("n_long"))
