"""What changed between full snapshots of a keyed table.

Every snapshot is cut into content-defined chunks of its key-sorted rows, the chunk digests of a
snapshot and of the one before it are compared, chunks whose digest occurs on both sides are dropped
unread, and only the rows of the remaining chunks are joined to classify them.

Plan. Rows are range-partitioned and sorted by (key, family), so no snapshot, however large, is ever one
task, and a partition border falls at the same key for all snapshots that are compared with each other
(a family): a border is just one more common cut. A chunk begins at a key whose hash is 0 modulo
`mean_rows`, so an inserted or removed row disturbs the chunk that holds it, not those behind it.

Defined results
- nulls: rows without snapshot id or key are no records; a null value is a value (null -> x is 'changed').
- repeated rows count once; if a snapshot has several values for a key, the greatest (nulls lowest) holds.
- an earlier or later snapshot without rows is an empty set: everything was added or removed.
- keys are compared exactly, the empty string is a key; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cairnlake.session import durable

MEAN_ROWS = 32


def nearest_ready(snapshots: DataFrame, *, ready: str = "ready") -> DataFrame:
    """(later, earlier): for each ready snapshot the nearest ready one up its parent chain.

    Chains are followed by pointer doubling, so a chain of n unready snapshots takes log2(n) joins; a
    chain that ends, breaks at a missing snapshot or runs in a circle gives no row.
    """
    s = snapshots.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max("parent_snapshot_id").alias("up"), F.max(F.col("status").eqNullSafe(ready)).alias("ok"))
    s = durable(s, "snapshots")
    # `up` of an unready snapshot is moved along until it names a ready one or nothing.
    links = s.filter(~F.col("ok") & F.col("up").isNotNull()).select("id", "up")
    state = s.select(F.col("id").alias("n"), "ok")
    links = durable(links.join(state, F.col("up") == F.col("n")).select("id", "up", F.col("ok").alias("done")), "links")
    rounds, longest = 0, 1
    while (open_links := links.filter(~F.col("done")).count()) and 2 ** (rounds - 1) <= longest:
        longest = max(longest, open_links)
        nxt = links.select(F.col("id").alias("n"), F.col("up").alias("up2"), F.col("done").alias("done2"))
        todo = links.filter(~F.col("done")).join(nxt, F.col("up") == F.col("n"))
        links = links.filter("done").unionByName(
            todo.select("id", F.col("up2").alias("up"), F.col("done2").alias("done")).filter(F.col("id") != F.col("up")))
        links, rounds = durable(links, "links"), rounds + 1
    jump = links.filter("done").select(F.col("id").alias("n"), F.col("up").alias("far"))
    start = s.filter(F.col("ok") & F.col("up").isNotNull()).select(F.col("id").alias("later"), "up")
    direct = start.join(state.filter("ok"), F.col("up") == F.col("n")).select("later", F.col("up").alias("earlier"))
    far = start.join(jump, F.col("up") == F.col("n")).select("later", F.col("far").alias("earlier"))
    return direct.unionByName(far).filter(F.col("later") != F.col("earlier"))


def _chunk_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the chunks in rows sorted by (family, key): a new family begins one, and so does a new key with cut."""
    chunk, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        fam, key = b.column("family"), b.column("key")
        new_fam, new_key = np.ones(len(fam), bool), np.ones(len(fam), bool)
        new_fam[1:] = pc.not_equal(fam[1:], fam[:-1]).to_numpy(zero_copy_only=False)
        new_key[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        if last is not None:
            new_fam[0], new_key[0] = fam[0].as_py() != last[0], key[0].as_py() != last[1]
        ids = chunk + np.cumsum(new_fam | (new_key & b.column("cut").to_numpy(zero_copy_only=False)))
        chunk, last = int(ids[-1]), (fam[-1].as_py(), key[-1].as_py())
        yield pa.RecordBatch.from_arrays([b.column("snap"), b.column("part"), pa.array(ids, pa.int64()), key, b.column("val")], names=["snap", "part", "chunk", "key", "val"])


def chunked_rows(rows: DataFrame, mean_rows: int, kind: str = "string") -> DataFrame:
    """rows (snap, family, key, val) with the chunk each is in."""
    # One border per (key, family): the same for all snapshots of a family.
    placed = rows.repartitionByRange("key", "family").withColumn("part", F.spark_partition_id()).sortWithinPartitions("family", "key")
    placed = placed.withColumn("cut", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(mean_rows)) == 0)
    return placed.mapInArrow(_chunk_ids, f"snap bigint, part int, chunk bigint, key string, val {kind}")


def changes(rows: DataFrame, pairs: DataFrame, families: DataFrame | None = None, *, snapshot: str = "snapshot_id", key: str = "path",
            value: str = "blob_sha", mean_rows: int = MEAN_ROWS, values: bool = True) -> DataFrame:
    """(later, earlier, key, change, old, new) for the rows of `rows` and the (later, earlier) of `pairs`.

    Without `values` old and new are 128-bit hashes: once the greatest value of a key is known, only its hash moves on.

    change is 'added', 'removed' or 'changed'. families (snap, family), one row per snapshot, says which
    snapshots share their cuts; a key that all snapshots have is then spread over the families. Two members
    of a pair in different families, or in none, cost speed, never rows.
    """
    pairs = durable(pairs.select("later", "earlier").filter("later is not null and earlier is not null").distinct(), "pairs")
    used = pairs.select(F.col("later").alias("name")).union(pairs.select(F.col("earlier").alias("name"))).distinct()
    if families is not None:
        used = used.join(families.select(F.col("snap").alias("name"), "family"), "name", "left")
    else:
        used = used.withColumn("family", F.lit(""))
    # snapshots and families go by number, rows are many times more than they are
    used = durable(used.select("name", F.xxhash64("family").alias("family"), F.monotonically_increasing_id().alias("snap")), "used")
    number = used.select("name", "snap")
    links = pairs.join(number.select(F.col("name").alias("later"), F.col("snap").alias("l")), "later").join(number.select(F.col("name").alias("earlier"), F.col("snap").alias("e")), "earlier")
    links = durable(links, "numbered")
    clean = (rows.select(F.col(snapshot).alias("name"), F.col(key).alias("key"), F.col(value).alias("val")).filter("name is not null and key is not null")
             .join(used, "name").groupBy("snap", "family", "key").agg(F.max("val").alias("val")))
    if not values:
        clean = clean.withColumn("val", F.unhex(F.md5("val")))
    table = durable(chunked_rows(clean, mean_rows, "string" if values else "binary"), "chunked")

    # Digest of a chunk: two sums of 64-bit hashes and the row count, independent of row order.
    h1 = F.xxhash64("key", F.col("val").isNull(), "val").cast("decimal(20,0)")
    h2 = F.xxhash64(F.lit(1), F.col("val").isNull(), "val", F.lit(2), "key").cast("decimal(20,0)")
    digests = table.groupBy("snap", "part", "chunk").agg(F.sum(h1).alias("d1"), F.sum(h2).alias("d2"), F.count("*").alias("n"))
    ends = links.select("l", "e")
    sides = digests.join(ends, F.col("snap") == F.col("l")).withColumn("new_side", F.lit(True)).unionByName(
        digests.join(ends, F.col("snap") == F.col("e")).withColumn("new_side", F.lit(False)))
    open_chunks = (sides.groupBy("l", "e", "d1", "d2", "n")
                   .agg(F.count("*").alias("seen"), F.first(F.struct("snap", "part", "chunk", "new_side")).alias("c"))
                   .filter("seen = 1").select("l", "e", "c.*"))
    left = open_chunks.join(table, ["snap", "part", "chunk"])
    new = left.filter("new_side").select("l", "e", "key", F.col("val").alias("new"), F.lit(1).alias("in_new"))
    old = left.filter("not new_side").select("l", "e", "key", F.col("val").alias("old"), F.lit(1).alias("in_old"))
    both = new.join(old, ["l", "e", "key"], "full_outer").join(links, ["l", "e"])
    return both.filter(F.col("in_new").isNull() | F.col("in_old").isNull() | ~F.col("new").eqNullSafe(F.col("old"))).select(
        "later", "earlier", "key",
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed").alias("change"),
        "old", "new")
