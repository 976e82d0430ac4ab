"""Queries: nearest vectors of the embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.llm.similar_vectors import neighbours
from cairnlake.sources.tables import load


def _near(spark: SparkSession, data_dir: str) -> DataFrame:
    cols = ("embedding_model", "content_hash", "embedding")
    rows = load(spark, data_dir, "embedding_cache", *cols).unionByName(load(spark, data_dir, "code_chunks", *cols))
    return neighbours(rows, k=5, least=0.8)


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _near(spark, data_dir).select(
        F.col("model").alias("embedding_model"), F.least("key", "other").alias("hash_a"), F.greatest("key", "other").alias("hash_b")).distinct()


def p2_degrees(spark: SparkSession, data_dir: str) -> DataFrame:
    """How many vectors have how many of their five nearest at 0.8 or more."""
    per = _near(spark, data_dir).groupBy("model", "key").agg(F.count("*").alias("near"))
    return per.groupBy(F.col("model").alias("embedding_model"), "near").agg(F.count("*").alias("vectors"))


QUERIES = {"p2_found": p2_found, "p2_degrees": p2_degrees}
SQL = {
    "p2_found": """WITH every AS (SELECT embedding_model, content_hash, embedding FROM embedding_cache UNION ALL SELECT embedding_model, content_hash, embedding FROM code_chunks),
        raw AS (SELECT DISTINCT embedding_model AS m, content_hash AS h, embedding::DOUBLE[] AS e FROM every WHERE embedding IS NOT NULL),
        dims AS (SELECT embedding_model AS m, arg_max(d, n) AS d FROM (SELECT embedding_model, len(embedding) AS d, count(*) AS n FROM every WHERE embedding IS NOT NULL GROUP BY ALL) GROUP BY 1),
        v AS (SELECT raw.m, h, e FROM raw JOIN dims ON raw.m = dims.m AND len(e) = d),
        u AS (SELECT m, h, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
        s AS (SELECT a.m, a.h AS a, b.h AS b, list_inner_product(a.e, b.e) / (a.n * b.n) AS c FROM u a JOIN u b ON a.m = b.m AND a.h <> b.h),
        r AS (SELECT m, a, b FROM s WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY m, a ORDER BY c DESC, b) <= 5)
        SELECT DISTINCT m AS embedding_model, least(a, b) AS hash_a, greatest(a, b) AS hash_b FROM r""",
}
