"""Content-addressed index: manifests, chunks keyed by blob, caches, upserts and collection of what nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairnlake.session import durable


def manifest(files: DataFrame) -> DataFrame:
    """snapshot_files as a set, blob ids in lower case."""
    return files.select("snapshot_id", "path", F.lower("blob_sha").alias("blob_sha")).distinct()


def scoped_chunks(manifests: DataFrame, snapshots: DataFrame, chunks: DataFrame, version: str) -> DataFrame:
    """Chunks of each snapshot: manifest ⋈ chunks on repository and blob. The path is the manifest's, so a blob at two
    paths gives its chunks twice. Skew of one blob is met by the adaptive join, the key having the repository in it."""
    scope = manifests.join(snapshots.select(F.col("id").alias("snapshot_id"), "repository_id"), "snapshot_id")
    own = chunks.filter(F.col("chunker_version") == version).withColumn("blob_sha", F.lower("blob_sha")).drop("path")
    return scope.join(own, ["repository_id", "blob_sha"])


def referenced_blobs(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repository_id, blob_sha) that some existing snapshot refers to."""
    return manifests.join(snapshots.select(F.col("id").alias("snapshot_id"), "repository_id"), "snapshot_id").select("repository_id", "blob_sha").distinct()


def missing_blobs(manifests: DataFrame, snapshots: DataFrame, chunks: DataFrame) -> DataFrame:
    """Referenced blobs that have not been chunked, with the first path that names them."""
    have = chunks.select("repository_id", F.lower("blob_sha").alias("blob_sha"))
    refs = manifests.join(snapshots.select(F.col("id").alias("snapshot_id"), "repository_id"), "snapshot_id")
    return refs.groupBy("repository_id", "blob_sha").agg(F.min("path").alias("path")).join(have, ["repository_id", "blob_sha"], "left_anti")


def unreferenced_chunks(chunks: DataFrame, manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    return chunks.withColumn("blob_sha", F.lower("blob_sha")).join(referenced_blobs(manifests, snapshots), ["repository_id", "blob_sha"], "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str], keep_known: list[str] = ()) -> DataFrame:
    """Upsert read as 'the last row of a key holds'; columns of keep_known keep their last value that is not null.
    Aggregated, not sorted, so that a hot key is reduced before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys and c not in order and c not in keep_known]
    known = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(f"_{c}") for c in keep_known]
    out = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"), *known)
    return out.select(*keys, "_last.*", *[F.col(f"_{c}.{c}").alias(c) for c in keep_known])


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key, null equal to null, is not there yet; one row per key."""
    fresh = incoming.dropDuplicates(keys)
    cond = F.lit(True)
    for k in keys:
        cond = cond & fresh[k].eqNullSafe(existing[k])
    return fresh.join(existing, cond, "left_anti")


def patch_manifest(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A manifest (path, blob_sha) after changes (path, previous_path, status, blob_sha): removed and renamed paths go, the others are set."""
    gone = changes.select("path").unionByName(changes.filter("previous_path is not null").select(F.col("previous_path").alias("path"))).distinct()
    put = changes.filter("status <> 'removed' and blob_sha is not null").groupBy("path").agg(F.max("blob_sha").alias("blob_sha"))
    return base.join(gone, "path", "left_anti").select("path", "blob_sha").unionByName(put)


def cache_lookup(chunks: DataFrame, cache: DataFrame, key: str = "content_hash", model: str = "embedding_model") -> DataFrame:
    """Chunks with whether their (key, model) is in the cache."""
    have = cache.select(F.col(key), F.col(model)).distinct().withColumn("hit", F.lit(True))
    return chunks.join(have, [key, model], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def collectable(snapshots: DataFrame, in_use: DataFrame, as_of: Column, keep: int = 3, stale_hours: int = 6) -> DataFrame:
    """Snapshots to drop: ready ones beyond the newest `keep` of a repository that no job uses, and others older than stale_hours."""
    w = W.partitionBy("repository_id").orderBy(F.desc_nulls_first("finished_at"), "id")
    ready = snapshots.filter("status = 'ready'")
    # only the few kept ones are ranked; the rest is what is left
    kept = ready.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select("id")
    old = ready.join(kept, "id", "left_anti").join(in_use.select(F.col("snapshot_id").alias("id")).filter("id is not null").distinct(), "id", "left_anti").withColumn("reason", F.lit("superseded"))
    stale = snapshots.filter((F.col("status") != "ready") & (F.col("started_at") < as_of - F.expr(f"INTERVAL {stale_hours} HOURS"))).withColumn("reason", F.lit("stale"))
    return old.select("id", "repository_id", "reason").unionByName(stale.select("id", "repository_id", "reason"))


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that occur in rows, leave the others."""
    rows.repartition(F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key is not in the table at path; how many that were."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    existing = spark.read.parquet(path) if there else spark.createDataFrame([], rows.schema)
    fresh = durable(insert_new(existing, rows, keys), "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh.count()
