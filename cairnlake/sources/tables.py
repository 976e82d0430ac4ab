"""Readers for the tables of a data folder, one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, data_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name`; only `columns` reach the scan when given."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
