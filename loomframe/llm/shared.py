"""Tables and files in the folder that the driver and all executors share.

Lineage is cut only by writing here: a table written once survives the loss of
any executor, which a local checkpoint doesn't.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and one machine runs all, as in tests."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="loomframe-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/") if "://" in set_dir else "file://" + set_dir.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/loomframe/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch.
BATCH_BYTES = "8m"


def written(df: DataFrame, name: str, batch: int = 2000) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Arrow functions in its plan get ``batch`` rows and ``BATCH_BYTES`` at a time, which bounds their memory.
    """
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {setting: conf.get(setting) for setting in (rows, size)}
    conf.set(rows, str(min(batch, int(before[rows])) if int(before[rows]) > 0 else batch))
    conf.set(size, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        for setting, value in before.items():
            conf.set(setting, value)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomframe_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` made, once no later step reads them."""
    for table in tables:
        path = getattr(table, "_loomframe_path", None)
        if path:
            spark = table.sparkSession
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark clean the shuffle files of plans that nothing refers to any more; it does so only when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a filter of ids, and bits of each: at most 4 MB, whatever the number of ids.
FILTER_ROWS, FILTER_BITS = 1 << 18, 62


def _filtered(df: DataFrame, ids: DataFrame, column: str, held: bool) -> DataFrame:
    """Rows of ``df`` that the bit filter of ``ids`` lets pass, or those that it holds back."""
    row = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_ROWS)).cast("int")
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(FILTER_BITS)).cast("int")
    bits = ids.groupBy(row(F.col(column)).alias("_row")).agg(F.bit_or(F.expr("1L") * F.pow(F.lit(2.0), bit(F.col(column))).cast("long")).alias("_bits"))
    known = df.withColumn("_row", row(F.col(column))).join(F.broadcast(bits), "_row", "left" if held else "inner")
    known = known.filter(F.coalesce(F.getbit("_bits", bit(F.col(column))), F.lit(0)) == (0 if held else 1))
    return known.select(*df.columns)


def rows_with(df: DataFrame, ids: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """``df`` left-semi joined with ``ids``; a bit filter of bounded size is broadcast first, so few other rows are shuffled.

    With ``exact`` false the filter is all: some other rows stay, and nothing is shuffled.
    """
    near = _filtered(df, ids, column, held=False)
    # a semi or an anti join would be pushed below the filter
    return near.join(ids.select(column).distinct(), column).select(*df.columns) if exact else near


def rows_without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` left-anti joined with ``ids``, in two scans: rows that the same filter holds back stay without a shuffle."""
    near = _filtered(df, ids, column, held=False).join(ids.select(column, F.lit(True).alias("_held")).distinct(), column, "left")
    near = near.filter("_held is null").select(*df.columns)
    return _filtered(df, ids, column, held=True).unionByName(near)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key is hot when over one of so many counted rows have it; so hot keys are fewer than this and may be broadcast.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: list[str], copies: str = "copies") -> DataFrame:
    """``left`` with the columns of ``right`` (null where it has no such key), without a task that gathers one key.

    ``right`` is a written table of unique keys with the number of left rows of each. Hot keys are fewer than
    ``HOT_SHARE`` whatever the data, and are broadcast; left rows that a hot key has answered, and those without a
    full key, get a key of their own in the shuffle that joins the rest.
    """
    total = right.agg(F.sum(copies).alias("n")).first()["n"] or 0
    hot = right.filter(F.col(copies) > total / HOT_SHARE)
    given = [c for c in right.columns if c not in key]
    known = left.join(F.broadcast(hot.select(*key, *[F.col(c).alias(f"_hot_{c}") for c in given])), key, "left")
    cold = right.join(F.broadcast(hot.select(*key)), key, "left_anti")
    lacks = F.lit(False)
    for k in key:
        lacks = lacks | F.col(k).isNull()
    known = known.withColumn("_spread", F.when(F.col(f"_hot_{copies}").isNotNull() | lacks, F.xxhash64(*[c for c in left.columns if c not in key])).otherwise(F.lit(0)))
    cold = cold.select(*key, F.lit(0).cast("long").alias("_spread"), *[F.col(c).alias(f"_cold_{c}") for c in given])
    joined = known.join(cold, [*key, "_spread"], "left")
    return joined.select(*left.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in given])
