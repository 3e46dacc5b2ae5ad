"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quadrat.llm import fingerprints, html_text, language, mixing, near_dup, neighbours, packing, pieces, substring, token_store, toxicity, variants, vector_codes
from quadrat.session import shared_folder, stored
from quadrat.sources.tables import scan_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    store = shared_folder(spark, "token-store")
    token_store.write_store(scan_parquet(spark, folder, "documents"), store, "word_bpe_49k.json", keeps_space=False, end_id=1)
    return token_store.read_store(spark, store)


@query
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    sized = scan_parquet(spark, folder, "documents").select("doc_id", "source", mixing.n_words("text").alias("size"))
    return mixing.shares(stored(sized, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op2_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS k FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (SELECT sum(source_size) FROM sums)::DOUBLE AS total FROM sums),
levels AS (
  SELECT a.source, a.source_size, a.w, 3.0::DOUBLE * a.source_size AS most,
         (a.total - coalesce((SELECT sum(3.0::DOUBLE * b.source_size) FROM weighted b WHERE 3.0::DOUBLE * b.source_size / b.w < 3.0::DOUBLE * a.source_size / a.w), 0))
       / (SELECT sum(b.w) FROM weighted b WHERE NOT (3.0::DOUBLE * b.source_size / b.w < 3.0::DOUBLE * a.source_size / a.w)) AS level FROM weighted a),
targets AS (
  SELECT source, source_size, CASE WHEN most / w < level THEN most
         ELSE w * (SELECT max(level) FROM levels WHERE NOT most / w < level) END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed
"""


@query
def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(scan_parquet(spark, folder, "documents"), percent=85)


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(scan_parquet(spark, folder, "documents"))


@query
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.removal_digest(scan_parquet(spark, folder, "documents"))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_digest(scan_parquet(spark, folder, "documents"), scan_parquet(spark, folder, "labels"))


@query
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_digest(scan_parquet(spark, folder, "documents"))


@query
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(scan_parquet(spark, folder, "pages"))


@query
def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = scan_parquet(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_digest(scan_parquet(spark, folder, "documents"))


@query
def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_digest(scan_parquet(spark, folder, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group_variants(scan_parquet(spark, folder, "documents"))


SQL["op12_spelling_variants"] = variants.SQL


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_digest(scan_parquet(spark, folder, "embeddings"))


SQL["op13_vector_codes"] = vector_codes.SQL


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
