"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.operators.snapshot_changes import changes, nearest_ready
from cairnlake.sources.tables import load


def _changes(spark: SparkSession, data_dir: str) -> DataFrame:
    snaps = load(spark, data_dir, "repository_snapshots", "id", "repository_id", "parent_snapshot_id", "status")
    files = load(spark, data_dir, "snapshot_files", "snapshot_id", "path", "blob_sha")
    families = snaps.filter("id is not null").groupBy(F.col("id").alias("snap")).agg(F.max("repository_id").alias("family"))
    return changes(files.withColumn("blob_sha", F.lower("blob_sha")), nearest_ready(snaps), families, values=False)


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _changes(spark, data_dir).select(F.col("later").alias("snapshot_id"), F.col("key").alias("path"), "change")


def p1_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Changes per later snapshot."""
    c = F.col("change")
    return _changes(spark, data_dir).groupBy(F.col("later").alias("snapshot_id"), F.col("earlier").alias("earlier_id")).agg(
        F.count_if(c == "added").alias("added"), F.count_if(c == "removed").alias("removed"), F.count_if(c == "changed").alias("changed"))


_P1_CTE = """
WITH RECURSIVE s AS (SELECT id, max(parent_snapshot_id) AS up, max(CASE WHEN status = 'ready' THEN 1 ELSE 0 END) AS ok
                     FROM repository_snapshots WHERE id IS NOT NULL GROUP BY id),
chain(later, node, ok) AS (
  SELECT a.id, b.id, b.ok FROM s a JOIN s b ON a.up = b.id WHERE a.ok = 1
  UNION
  SELECT c.later, b.id, b.ok FROM chain c JOIN s a ON a.id = c.node JOIN s b ON a.up = b.id WHERE c.ok = 0),
pairs AS (SELECT later, node AS earlier FROM chain WHERE ok = 1 AND later <> node),
f AS (SELECT snapshot_id, path, max(lower(blob_sha)) AS sha FROM snapshot_files
      WHERE snapshot_id IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
n AS (SELECT later, earlier, path, sha FROM pairs JOIN f ON snapshot_id = later),
o AS (SELECT later, earlier, path, sha FROM pairs JOIN f ON snapshot_id = earlier),
d AS (SELECT coalesce(n.later, o.later) AS snapshot_id, coalesce(n.earlier, o.earlier) AS earlier_id, coalesce(n.path, o.path) AS path,
        CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM n FULL OUTER JOIN o ON n.later = o.later AND n.earlier = o.earlier AND n.path = o.path
      WHERE n.path IS NULL OR o.path IS NULL OR n.sha IS DISTINCT FROM o.sha)
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}

SQL = {
    "p1_found": _P1_CTE + "SELECT snapshot_id, path, change FROM d",
    "p1_counts": _P1_CTE + """SELECT snapshot_id, earlier_id, count(*) FILTER (WHERE change = 'added') AS added,
      count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed FROM d GROUP BY ALL""",
}
