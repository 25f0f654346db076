"""The register of named queries, each with DuckDB SQL that says the same, and the views of tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import media as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ORDER = ["us", "event_id"]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(t, *more: str) -> DataFrame:
    return t("events").select("event_id", "user_id", "event_type", M.micros("ts").alias("us"), *more)


def lines(t) -> DataFrame:
    return t("lineitem")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to as many tasks as there are cores: a file of a table may be one task's, however much is built from each row."""
    return df.repartition(key)
