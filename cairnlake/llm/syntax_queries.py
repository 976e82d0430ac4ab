"""Queries: files of code_chunks that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.llm.syntax_errors import parse_files, rates
from cairnlake.sources.tables import load


def _files(spark: SparkSession, data_dir: str) -> DataFrame:
    return parse_files(load(spark, data_dir, "code_chunks", "repository_id", "blob_sha", "chunker_version", "language", "path", "start_line", "content"))


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _files(spark, data_dir).filter("not valid").select("repository_id", "blob_sha").distinct()


def p5_rates(spark: SparkSession, data_dir: str) -> DataFrame:
    return rates(_files(spark, data_dir))


def p5_failures(spark: SparkSession, data_dir: str) -> DataFrame:
    """Where and why each invalid file fails."""
    return _files(spark, data_dir).filter("not valid").select("repository_id", "blob_sha", "chunker_version", "language", "path", "error_line", "cause")


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates, "p5_failures": p5_failures}
SQL: dict[str, str] = {}
