"""A linear chain of stages, composed before anything runs: Spark fuses, pipelines and schedules it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomframe.operators import timeline as T

Stage = Callable[[DataFrame], DataFrame]


class Pipeline:
    def __init__(self, stages: Iterable[Stage] = ()):
        self.stages = list(stages)

    def add(self, stage: Stage) -> Pipeline:
        return Pipeline([*self.stages, stage])

    def run(self, source: DataFrame) -> DataFrame:
        """The chain over ``source``; an empty chain is the source itself."""
        return reduce(lambda df, stage: df.transform(stage), self.stages, source)

    def traced(self, source: DataFrame) -> tuple[DataFrame, list[Observation]]:
        """The chain with the rows behind each stage counted while it runs; the counts are there once the result has been written."""
        seen = []
        for k, stage in enumerate(self.stages):
            seen.append(Observation(f"stage-{k}"))
            source = source.transform(stage).observe(seen[-1], F.count(F.lit(1)).alias("rows"))
        return source, seen


def until_error(messages: DataFrame, keys: Sequence[str], order: Sequence[str], is_error: Column) -> DataFrame:
    """Messages with ``is_error`` and ``visible``: true for those of a stream before its first error."""
    seen = T.segments(messages.withColumn("is_error", F.coalesce(is_error, F.lit(False))), keys, order, F.col("is_error"))
    return seen.withColumn("visible", F.col("segment") == 0).drop("segment")


def sunk(messages: DataFrame, is_error: Column, error: Column) -> DataFrame:
    """The messages; reading one that is an error fails with its text."""
    good = F.when(F.coalesce(is_error, F.lit(False)), F.raise_error(error).cast("boolean")).otherwise(F.lit(True))
    return messages.withColumn("_good", good).filter("_good").drop("_good")
