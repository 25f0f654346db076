"""One query for each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import langid, licences, mixing, near_vectors, ngram_join, records, tokens, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("lossless")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages"))


_NEAR_SQL = """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    l AS (
      SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
    r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.reached = l.x),
    c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
    n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
    SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN c ON e.vec_id = c.node LEFT JOIN n ON e.vec_id = n.x"""
_TOP_SQL = """
    WITH v AS (
      SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(1024 * c)) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, y.vec_id, CAST(list_dot_product(q.x, y.x) AS BIGINT) AS score
      FROM v q JOIN v y ON q.vec_id <> y.vec_id AND len(q.x) = len(y.x) WHERE q.vec_id % 100 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 10"""
_NGRAM_SQL = r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
      FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS shingles FROM w),
    n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, shingles FROM s),
    e AS (SELECT doc_id, n_shingles, unnest(shingles) AS shingle FROM n),
    p AS (
      SELECT a.doc_id AS x, b.doc_id AS y, a.n_shingles AS nx, b.n_shingles AS ny, count(*) AS both_have
      FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p WHERE 100 * both_have >= 75 * (nx + ny - both_have)),
    r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, l.y FROM r JOIN l ON r.reached = l.x)
    SELECT n.doc_id, n.n_shingles, c.component_id
    FROM n JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) c ON n.doc_id = c.node"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_mixing, op3_near_vectors, op4_bpe_round_trip, op5_ngram_join, op6_top_k, op7_licence_scan, op8_language_id, op9_token_records, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_vectors": _NEAR_SQL,
        "op5_ngram_join": _NGRAM_SQL,
        "op6_top_k": _TOP_SQL,
        "op7_licence_scan": licences.licence_sql(),
        "op10_warc": """
            WITH p AS (
              SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
              CASE WHEN payload_bytes < 100 OR page_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
              CASE WHEN payload_bytes < 100 OR page_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
            FROM f""",
    }
