"""Queries: documents that hold passages of evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.llm.leakage import leaks
from cairnlake.sources.tables import load


def p8_passages(spark: SparkSession, data_dir: str) -> DataFrame:
    """The longest passage of each item in each document that holds one."""
    return leaks(load(spark, data_dir, "documents", "doc_id", "text"), load(spark, data_dir, "eval_cases", "case_id", "body", "new_code"))


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return p8_passages(spark, data_dir).select("doc_id", "case_id")


def p8_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """How often each evaluation item leaked."""
    return p8_passages(spark, data_dir).groupBy("case_id").agg(F.count("*").alias("documents"), F.max("passage_words").alias("longest"))


QUERIES = {"p8_found": p8_found, "p8_passages": p8_passages, "p8_items": p8_items}
SQL: dict[str, str] = {}
