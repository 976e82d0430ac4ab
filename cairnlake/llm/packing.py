"""Filling containers of a fixed number of tokens with whole documents.

Hierarchical residual packing: items are spread over partitions by hash and packed there best-fit, largest
first. Bins filled to `full_share` are emitted; the others go on as single items, only their number and
load, to a round with as many fewer partitions as they are fewer, where they are packed again, and so on up a
tree until one partition has seen the last of them, or a round found nothing more to join. A container's members are found by following the few links.

Plan. Sizes are computed once and kept; every round moves only what the round before left open, so the
total moved is little more than the items themselves. Groups are of a fixed size, partitions are as many as the
session shuffles into and hold many groups, one after the other. Each round writes the links of its own items once; at
the end they are followed upward from the last round, whose items are few, to the first.

Defined results
- every document has one row, or one row per piece if it alone exceeds the capacity: pieces of exactly
  the capacity and a rest, the rest packed like any item.
- null or empty texts have size 0 and share a container with others. Repeated rows of an id count once, of
  different texts under an id the greatest size holds; null ids are left out. Extra columns are ignored.
- an empty table has no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnlake.llm.credentials import VOCABULARY, encoder, share
from cairnlake.session import durable

CAPACITY, FULL_SHARE, ITEMS_PER_PARTITION = 4096, 0.995, 50_000


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(encoder(vocabulary).encode_ordinary(text))


def _sizes(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, vocabulary) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])
    return run


def token_sizes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens), one row per document."""
    share(docs.sparkSession, vocabulary)
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    return slim.mapInArrow(_sizes(vocabulary), "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each item, taken in order, and the room left in each bin: the fullest bin that still holds an item gets it."""
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set while a bin has room r
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = open_rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            same = by_room[room]
            b = same.pop()
            if not same:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        room -= s
        rooms[b] = room
        by_room.setdefault(room, []).append(b)
        open_rooms |= 1 << room
        out[i] = b
    return out, rooms


def _pack(level: int, capacity: int, full: int, last: bool):
    """Packs a partition: one row per item with its bin, and whether the bin is closed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, item, size in _groups(batches):
            order = np.lexsort((item, -size))
            item, size = item[order], size[order]
            bins, rooms = best_fit(size, capacity)
            load = capacity - np.array(rooms, np.int64)
            # a bin number that no other group or round gives
            number = (np.int64(level) << 58) | (np.int64(p) << 34) | np.arange(len(rooms), dtype=np.int64)
            closed = (load >= full) | last
            for at in range(0, len(item), 100_000):
                k = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(item[k]), pa.array(size[k]), pa.array(number[bins[k]]), pa.array(load[bins[k]]), pa.array(closed[bins[k]])],
                                                 names=["item", "size", "bin", "load", "closed"])
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, items, sizes) of a partition sorted by group, one group at a time."""
    now, held = -1, []
    for b in batches:
        if not b.num_rows:
            continue
        part, item, size = (b.column(c).to_numpy() for c in ("part", "item", "size"))
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, z in zip(starts, np.append(starts[1:], len(part))):
            if part[a] != now and held:
                yield now, *map(np.concatenate, zip(*held))
                held = []
            now = int(part[a])
            held.append((item[a:z], size[a:z]))
    if held:
        yield now, *map(np.concatenate, zip(*held))


PACKED = "item bigint, size bigint, bin bigint, load bigint, closed boolean"


def pack(sizes: DataFrame, *, capacity: int = CAPACITY, full_share: float = FULL_SHARE, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """(doc_id, piece_no, start_token, tokens, container_id) for sizes (doc_id, tokens)."""
    full = int(capacity * full_share)
    whole = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / capacity).cast("int")
    pieces = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece")).select(
        "doc_id", (F.col("piece") + 1).alias("piece_no"), (F.col("piece").cast("bigint") * capacity).alias("start_token"),
        F.least(F.col("tokens") - F.col("piece").cast("bigint") * capacity, F.lit(capacity).cast("bigint")).alias("size"))
    items = durable(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")

    count = items.count()
    groups = max(1, -(-count // items_per_partition))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, steps, before = items.select("item", "size"), [], count
    while True:
        placed = todo.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("bigint"))
        placed = placed.repartition(min(groups, tasks), "part").sortWithinPartitions("part") if groups > 1 else placed.coalesce(1)
        done = durable(placed.select("part", "item", "size").mapInArrow(_pack(len(steps) + 1, capacity, full, groups == 1), PACKED), f"round{len(steps) + 1}")
        steps.append(done.select("item", "bin", "closed"))
        if groups == 1:
            break
        # what a round left open is an item of the next
        todo = durable(done.filter("not closed").select(F.col("bin").alias("item"), F.col("load").alias("size")).distinct(), "open")
        left = todo.count()
        fewer = max(1, -(-left // items_per_partition))
        # items that fit with no other stay alone in their bins: they are not brought together in one task for nothing
        if left == 0 or fewer >= groups and left > 0.9 * before:
            break
        groups, before = fewer, left
    # from the top of the tree down: a bin left open is where the next round put it
    last = steps[-1].select("item", "bin")
    for step in reversed(steps[:-1]):
        up = last.select(F.col("item").alias("bin"), F.col("bin").alias("final"))
        moved = step.filter("not closed").join(up, "bin").select("item", F.col("final").alias("bin"))
        last = step.filter("closed").select("item", "bin").unionByName(moved)
    return items.join(last, "item").select("doc_id", "piece_no", "start_token", F.col("size").alias("tokens"), F.col("bin").alias("container_id"))


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, items, tokens, unused)."""
    return packed.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))
