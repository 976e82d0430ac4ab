"""Queries: oversized chunks cut into pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.llm.split_oversized import split
from cairnlake.sources.tables import load


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    chunks = load(spark, data_dir, "code_chunks", "id", "start_line", "content")
    return split(chunks, keep_small=False).filter("piece_no = 2").select(F.col("item_id").alias("chunk_id"))


def p6_pieces(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every chunk as pieces within the limit."""
    return split(load(spark, data_dir, "code_chunks", "id", "start_line", "content")).withColumnRenamed("item_id", "chunk_id")


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
SQL = {"p6_found": "SELECT DISTINCT id AS chunk_id FROM code_chunks WHERE greatest(1, length(content) // 4) > 800"}
