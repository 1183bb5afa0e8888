"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language_id, language_model, line_dedup, packing, pii, quality, secrets, similarity
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.keep_bitmaps(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.links(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "n_rows")


_QUERIES = (op1_quality_classifier, op2_best_fit_packing, op3_language_id, op4_decontaminate, op5_lm_scoring, op6_line_dedup, op7_ngram_jaccard_join, op8_secret_scan, op9_pii, op10_exact_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": """
            WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(unnest(string_split(text, chr(10))), concat(' ', chr(9), chr(13))) AS line
                       FROM documents WHERE text IS NOT NULL),
            k AS (SELECT doc_id, pos, line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM l),
            g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS run FROM k),
            r AS (SELECT doc_id, keep, min(pos) AS a, count(*) AS n FROM g GROUP BY doc_id, keep, run)
            SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE keep), 0) AS INTEGER) AS n_kept,
              concat(CASE WHEN arg_min(keep, a) THEN '' ELSE '0,' END, string_agg(CAST(n AS VARCHAR), ',' ORDER BY a)) AS keep_bitmap
            FROM r GROUP BY doc_id""",
        "op10_exact_dedup": """
            SELECT doc_id, keep_id, CAST(1 AS BIGINT) AS n_rows FROM (
              SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL)
            WHERE doc_id <> keep_id""",
    }
