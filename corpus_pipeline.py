"""The corpus pipeline: language ID, near-duplicate removal, mixing to target weights, and BPE ids.

Every stage works on all rows that the one before kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import langid, mixing, ngram_join, tokens
from loomframe.llm.shared import new_folder, rows_with, rows_without, written

#: No SQL can train the two models.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: null texts and texts without a letter. All others stay, in whatever language.

    The language predicted and its score decide nothing else. Without labelled text to learn from there is no
    prediction, and the same documents go.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.filter(langid.has_letter("text"))
    return langid.predict(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by the n-gram Jaccard join, that with the smallest id stays.

    Of rows that repeat an id the least one stays (by its columns in order, nulls last), if any of the group does; rows
    without an id all stay. Texts without words are alike to nothing. An empty table gives no rows.
    """
    groups = written(ngram_join.ngram_join(docs), "pipeline-groups")
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = rows_without(docs, gone, "doc_id")
    repeated = groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    # each column as (is null, value), so that nulls come last
    row = F.struct(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`").alias("v")).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    least = rows_with(kept, repeated, "doc_id").groupBy("doc_id").agg(F.min(row).alias("_row"))
    return least.select(*[F.col(f"_row.c{k}.v").alias(c) for k, c in enumerate(docs.columns)]).unionByName(rows_without(kept, repeated, "doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: rates bring expected words of the labelled domains to the target weights.

    Null and empty texts have no words; their rates are those of no evidence. Rows without an id, and repeated rows, are
    rated like all others, and rows that agree in id and text are taken equally often. An empty table gives no rows.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids and of the decoded text, whether it is the text, and the ids.

    A row for each row, whatever its id; null and empty texts have no ids. An empty table gives no rows.
    """
    return tokens.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("mixing", mix), ("BPE", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        path = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
