"""Queries: the content-addressed index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.operators import index as I
from cairnlake.plans.text_queries import chunks
from cairnlake.sources.tables import load

VERSION = "1"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return I.manifest(load(spark, d, "snapshot_files", "snapshot_id", "path", "blob_sha"))


def _snaps(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return load(spark, d, "repository_snapshots", "id", "repository_id", *cols)


def a10_scoped_chunks(spark, d):
    c = chunks(spark, d, "id", "repository_id", "blob_sha", "chunker_version", "path", "symbol_type", "token_count")
    s = I.scoped_chunks(_files(spark, d), _snaps(spark, d, "status").filter("status = 'ready'"), c, VERSION)
    return s.groupBy("snapshot_id").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("paths"), F.sum("token_count").alias("tokens"))


def a14_existing_paths(spark, d):
    """Of the chunked paths, those that occur in some manifest of their repository: the few differ by case or are gone."""
    p = load(spark, d, "code_chunks", "repository_id", "path").distinct()
    m = _files(spark, d).join(_snaps(spark, d).withColumnRenamed("id", "snapshot_id"), "snapshot_id").select("repository_id", "path")
    return p.join(m, ["repository_id", "path"], "left_semi")


def a19_latest_snapshots(spark, d):
    s = _snaps(spark, d, "status", "started_at")
    return s.orderBy(F.desc("started_at"), "id").limit(10).select("id", "repository_id", "status")


def b1_latest_jobs(spark, d):
    """The last job of each pull request, with the last base commit known."""
    j = load(spark, d, "review_jobs", "id", "repository_id", "pull_number", "base_sha", "head_sha", "status", "created_at").distinct()
    return I.latest(j, ["repository_id", "pull_number"], ["created_at", "id"], ["base_sha"]).select("repository_id", "pull_number", "id", "base_sha", "head_sha", "status")


def b11_collectable_snapshots(spark, d):
    s = _snaps(spark, d, "status", "started_at", "finished_at")
    jobs = load(spark, d, "review_jobs", "snapshot_id")
    return I.collectable(s, jobs, F.lit("2100-01-01 00:00:00").cast("timestamp_ntz"))


def d2_chunk_counts(spark, d):
    """Chunks of each ready snapshot and whether its stored count is stale."""
    c = chunks(spark, d, "id", "repository_id", "blob_sha", "chunker_version", "path")
    snaps = _snaps(spark, d, "status", "chunk_count").filter("status = 'ready'")
    n = I.scoped_chunks(_files(spark, d), snaps, c, VERSION).groupBy("snapshot_id").agg(F.count("*").alias("n"))
    return snaps.join(n, F.col("id") == F.col("snapshot_id"), "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("chunks"), (F.coalesce("n", F.lit(0)) != F.col("chunk_count")).alias("stale"))


def d4_unreferenced_chunks(spark, d):
    """Chunks that no failed snapshot refers to."""
    c = chunks(spark, d, "id", "repository_id", "blob_sha", "token_count")
    failed = _snaps(spark, d, "status").filter("status = 'failed'")
    return I.unreferenced_chunks(c, _files(spark, d), failed).groupBy("repository_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def d6_missing_blobs(spark, d):
    return I.missing_blobs(_files(spark, d), _snaps(spark, d), load(spark, d, "code_chunks", "repository_id", "blob_sha"))


def d7_cache_hits(spark, d):
    c = chunks(spark, d, "id", "content_hash", "embedding_model").filter("embedding_model is not null")
    h = I.cache_lookup(c, load(spark, d, "embedding_cache", "content_hash", "embedding_model"))
    return h.groupBy("embedding_model").agg(F.count("*").alias("chunks"), F.count_if("hit").alias("hits"), F.countDistinct("content_hash").alias("keys"))


def d27_patched_manifests(spark, d):
    """Each job's snapshot with the job's changed files put into its manifest: size of the result."""
    jobs = load(spark, d, "review_jobs", "id", "snapshot_id").distinct().filter("snapshot_id is not null")
    ch = load(spark, d, "changed_files", "review_job_id", "path", "previous_path", "status", "blob_sha").distinct().join(jobs, F.col("review_job_id") == F.col("id")).select(
        F.concat_ws("|", "id", "path").alias("path"), F.concat(F.col("id"), F.lit("|"), F.col("previous_path")).alias("previous_path"), "status", F.lower("blob_sha").alias("blob_sha"))
    base = _files(spark, d).join(jobs, "snapshot_id").select(F.concat_ws("|", "id", "path").alias("path"), "blob_sha")
    out = I.patch_manifest(base, ch)
    return out.groupBy(F.substring_index("path", "|", 1).alias("job_id")).agg(F.count("*").alias("paths"), F.countDistinct("blob_sha").alias("blobs"))


def f18_first_paths(spark, d):
    """Per repository and blob the first path that names it, and how many do."""
    m = _files(spark, d).join(_snaps(spark, d).withColumnRenamed("id", "snapshot_id"), "snapshot_id")
    return m.groupBy("repository_id", "blob_sha").agg(F.min("path").alias("first_path"), F.countDistinct("path").alias("paths"))


def g3_latest_ready(spark, d):
    """The newest ready snapshot of each repository."""
    s = _snaps(spark, d, "status", "finished_at").filter("status = 'ready' and finished_at is not null")
    return s.groupBy("repository_id").agg(F.max(F.struct("finished_at", "id")).alias("m")).select("repository_id", F.col("m.id").alias("snapshot_id"))


def i8_known_paths(spark, d):
    """Paths of the changed files and of the manifests together, per repository."""
    m = _files(spark, d).join(_snaps(spark, d).withColumnRenamed("id", "snapshot_id"), "snapshot_id").select("repository_id", "path")
    c = load(spark, d, "changed_files", "repository_id", "path", "previous_path")
    p = m.unionByName(c.select("repository_id", "path")).unionByName(c.filter("previous_path is not null").select("repository_id", F.col("previous_path").alias("path"))).distinct()
    return p.groupBy("repository_id").agg(F.count("*").alias("paths"))


QUERIES = {f.__name__: f for f in (
    a10_scoped_chunks, a14_existing_paths, a19_latest_snapshots, b1_latest_jobs, b11_collectable_snapshots, d2_chunk_counts, d4_unreferenced_chunks, d6_missing_blobs,
    d7_cache_hits, d27_patched_manifests, f18_first_paths, g3_latest_ready, i8_known_paths)}

_M = "m AS (SELECT DISTINCT snapshot_id, path, lower(blob_sha) AS blob_sha FROM snapshot_files)"
_MR = _M + ", mr AS (SELECT m.*, s.repository_id FROM m JOIN repository_snapshots s ON s.id = m.snapshot_id)"
_SC = _M + (", c AS (SELECT DISTINCT id, repository_id, lower(blob_sha) AS blob_sha, token_count FROM code_chunks WHERE chunker_version = '1'), "
            "sc AS (SELECT m.snapshot_id, m.path, c.id, c.token_count FROM m JOIN repository_snapshots s ON s.id = m.snapshot_id AND s.status = 'ready' JOIN c ON c.repository_id = s.repository_id AND c.blob_sha = m.blob_sha)")

SQL = {
    "a10_scoped_chunks": f"WITH {_SC} SELECT snapshot_id, count(*) AS chunks, count(DISTINCT path) AS paths, sum(token_count)::BIGINT AS tokens FROM sc GROUP BY 1",
    "a14_existing_paths": f"WITH {_MR} SELECT DISTINCT repository_id, path FROM code_chunks f WHERE EXISTS (SELECT 1 FROM mr WHERE mr.repository_id = f.repository_id AND mr.path = f.path)",
    "a19_latest_snapshots": "SELECT id, repository_id, status FROM repository_snapshots ORDER BY started_at DESC NULLS LAST, id LIMIT 10",
    "b1_latest_jobs": """WITH j AS (SELECT DISTINCT id, repository_id, pull_number, base_sha, head_sha, status, created_at FROM review_jobs),
        r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, pull_number ORDER BY created_at DESC, id DESC) AS n FROM j),
        b AS (SELECT repository_id, pull_number, arg_max(base_sha, (created_at, id)) AS base_sha FROM j WHERE base_sha IS NOT NULL GROUP BY ALL)
        SELECT r.repository_id, r.pull_number, r.id, b.base_sha, r.head_sha, r.status FROM r LEFT JOIN b ON b.repository_id = r.repository_id AND b.pull_number = r.pull_number WHERE n = 1""",
    "b11_collectable_snapshots": """WITH r AS (SELECT id, repository_id, row_number() OVER (PARTITION BY repository_id ORDER BY finished_at DESC NULLS FIRST, id) AS n FROM repository_snapshots WHERE status = 'ready')
        SELECT id, repository_id, 'superseded' AS reason FROM r WHERE n > 3 AND NOT EXISTS (SELECT 1 FROM review_jobs j WHERE j.snapshot_id = r.id)
        UNION ALL SELECT id, repository_id, 'stale' FROM repository_snapshots WHERE status <> 'ready' AND started_at < TIMESTAMP '2100-01-01' - INTERVAL 6 HOURS""",
    "d2_chunk_counts": f"WITH {_SC}, n AS (SELECT snapshot_id, count(*) AS n FROM sc GROUP BY 1) SELECT id, coalesce(n, 0) AS chunks, coalesce(n, 0) <> chunk_count AS stale FROM repository_snapshots LEFT JOIN n ON snapshot_id = id WHERE status = 'ready'",
    "d4_unreferenced_chunks": f"""WITH {_M}, mr AS (SELECT m.*, s.repository_id FROM m JOIN repository_snapshots s ON s.id = m.snapshot_id AND s.status = 'failed'), c AS (SELECT DISTINCT id, repository_id, lower(blob_sha) AS blob_sha, token_count FROM code_chunks)
        SELECT repository_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM c WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.repository_id = c.repository_id AND mr.blob_sha = c.blob_sha) GROUP BY 1""",
    "d6_missing_blobs": f"""WITH {_MR} SELECT repository_id, blob_sha, min(path) AS path FROM mr
        WHERE NOT EXISTS (SELECT 1 FROM code_chunks c WHERE c.repository_id = mr.repository_id AND lower(c.blob_sha) = mr.blob_sha) GROUP BY ALL""",
    "d7_cache_hits": """WITH c AS (SELECT DISTINCT id, content_hash, embedding_model FROM code_chunks WHERE embedding_model IS NOT NULL)
        SELECT embedding_model, count(*) AS chunks, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM embedding_cache e WHERE e.content_hash = c.content_hash AND e.embedding_model = c.embedding_model)) AS hits,
          count(DISTINCT content_hash) AS keys FROM c GROUP BY 1""",
    "d27_patched_manifests": f"""WITH {_M}, j AS (SELECT DISTINCT id, snapshot_id FROM review_jobs WHERE snapshot_id IS NOT NULL),
        f AS (SELECT DISTINCT j.id, path, previous_path, status, lower(blob_sha) AS blob_sha FROM changed_files c JOIN j ON j.id = c.review_job_id),
        gone AS (SELECT id, path FROM f UNION SELECT id, previous_path FROM f WHERE previous_path IS NOT NULL),
        kept AS (SELECT j.id, m.path, m.blob_sha FROM m JOIN j ON j.snapshot_id = m.snapshot_id WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = j.id AND g.path = m.path)),
        put AS (SELECT id, path, max(blob_sha) AS blob_sha FROM f WHERE status <> 'removed' AND blob_sha IS NOT NULL GROUP BY ALL)
        SELECT id AS job_id, count(*) AS paths, count(DISTINCT blob_sha) AS blobs FROM (SELECT * FROM kept UNION ALL SELECT * FROM put) GROUP BY 1""",
    "f18_first_paths": f"WITH {_MR} SELECT repository_id, blob_sha, min(path) AS first_path, count(DISTINCT path) AS paths FROM mr GROUP BY ALL",
    "g3_latest_ready": "SELECT repository_id, arg_max(id, (finished_at, id)) AS snapshot_id FROM repository_snapshots WHERE status = 'ready' AND finished_at IS NOT NULL GROUP BY 1",
    "i8_known_paths": f"""WITH {_MR} SELECT repository_id, count(*) AS paths FROM (SELECT repository_id, path FROM mr UNION SELECT repository_id, path FROM changed_files
        UNION SELECT repository_id, previous_path FROM changed_files WHERE previous_path IS NOT NULL) GROUP BY 1""",
}
