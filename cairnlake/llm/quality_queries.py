"""Queries: text statistics of the documents and what is not prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.llm.text_quality import NAMES, STATS, measure, outlierness
from cairnlake.session import durable
from cairnlake.sources.tables import load


def _stats(spark: SparkSession, data_dir: str) -> DataFrame:
    return durable(measure(load(spark, data_dir, "documents", "doc_id", "text")), "statistics")


def p9_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Outliers of their language's prose, and documents without words."""
    return outlierness(_stats(spark, data_dir)).filter("is_outlier").select("doc_id")


def p9_statistics(spark: SparkSession, data_dir: str) -> DataFrame:
    return _stats(spark, data_dir).select("doc_id", "language", "words", *[F.round(s, 6).alias(s) for s in STATS])


def p9_outlierness(spark: SparkSession, data_dir: str) -> DataFrame:
    """Distance of every document and the contribution of each statistic to it."""
    d = outlierness(_stats(spark, data_dir))
    return d.select("doc_id", "language", "words", "is_outlier", F.round("distance", 4).alias("distance"), *[F.round(f"c_{s}", 4).alias(f"c_{s}") for s in NAMES])


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p9_outlierness": p9_outlierness}
SQL: dict[str, str] = {}
