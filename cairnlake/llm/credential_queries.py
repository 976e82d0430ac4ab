"""Queries: credentials in chunks and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.llm.credentials import redact_rows, scan
from cairnlake.sources.tables import load


def _found(spark: SparkSession, data_dir: str) -> DataFrame:
    chunks = scan(load(spark, data_dir, "code_chunks", "id", "content"))
    patches = scan(load(spark, data_dir, "changed_files", "id", "patch"), text="patch", is_patch=True)
    return chunks.withColumn("src", F.lit("code_chunks")).unionByName(patches.withColumn("src", F.lit("changed_files")))


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _found(spark, data_dir).select("src", "row_id", "line_no").distinct()


def p3_kinds(spark: SparkSession, data_dir: str) -> DataFrame:
    """Findings by source and kind."""
    return _found(spark, data_dir).groupBy("src", "kind").agg(F.count("*").alias("found"), F.countDistinct("row_id").alias("rows"))


def p3_redacted(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every chunk and every patch with its credentials overwritten; repeated rows count once."""
    chunks = redact_rows(load(spark, data_dir, "code_chunks", "id", "content").distinct())
    patches = redact_rows(load(spark, data_dir, "changed_files", "id", "patch").distinct(), text="patch", is_patch=True)
    both = chunks.withColumn("src", F.lit("code_chunks")).unionByName(patches.withColumn("src", F.lit("changed_files")))
    return both.select("src", "row_id", "n_found", "redacted")


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds, "p3_redacted": p3_redacted}
SQL: dict[str, str] = {}
