"""Queries: documents packed into containers of 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.llm.packing import containers, pack, token_sizes
from cairnlake.sources.tables import load


def p7_packed(spark: SparkSession, data_dir: str) -> DataFrame:
    """The container of every document, and of every piece of those that are too long."""
    return pack(token_sizes(load(spark, data_dir, "documents", "doc_id", "text")))


def p7_fill(spark: SparkSession, data_dir: str) -> DataFrame:
    """Containers, tokens and unused room in all."""
    return containers(p7_packed(spark, data_dir)).agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"), F.min("unused").alias("least_unused"))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
