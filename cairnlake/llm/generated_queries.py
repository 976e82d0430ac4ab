"""Queries: files of the changed_files table that nobody wrote by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.llm.generated_files import classify
from cairnlake.sources.tables import load


def _kinds(spark: SparkSession, data_dir: str) -> DataFrame:
    return classify(load(spark, data_dir, "changed_files", "id", "repository_id", "path", "patch"))


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _kinds(spark, data_dir).filter("kind <> 'source'").select(F.col("repo").alias("repository_id"), "path")


def p4_kinds(spark: SparkSession, data_dir: str) -> DataFrame:
    """Files per repository, kind and kind of evidence."""
    return _kinds(spark, data_dir).groupBy(F.col("repo").alias("repository_id"), "kind", "by").agg(F.count("*").alias("files"))


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds}
SQL: dict[str, str] = {}
