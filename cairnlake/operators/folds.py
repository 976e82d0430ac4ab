"""Order-dependent selections: what the next item gets depends on what the ones before it took.

Every fold runs within one file, bundle or job, never over a repository, so a group is bounded by what one file or
job holds. Ties are broken by the last sort key, which callers make unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairnlake.functions import fixed_values as V


#: A sort key: the name of a column, with '-' in front for falling order.
def _sort_key(name: str) -> Column:
    return F.desc(name[1:]) if name.startswith("-") else F.asc(name)


def in_order(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], result: str, kind: str, fold: Callable[[list[tuple]], Iterable]) -> DataFrame:
    """(keys, fields, result): the rows of each group in order, with the values that fold(rows of fields) gives them one by one.

    Groups come sorted, so a partition is gone through once and no more than one group is held; a group is what one file, bundle or
    job holds.
    """
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *map(_sort_key, order)).select(*keys, *fields)
    schema = ", ".join([f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in placed.columns] + [f"{result} {kind}"])
    arrow, n = {"int": pa.int32(), "boolean": pa.bool_()}[kind], len(keys)

    def folded(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = list(fold([row for b in parts for row in zip(*(b.column(i).to_pylist() for i in range(n, b.num_columns)))]))
        at = 0
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[at:at + b.num_rows], arrow)], names=[*b.schema.names, result])
            at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            keyed = list(zip(*(b.column(i).to_pylist() for i in range(n))))
            starts = [r for r in range(1, len(keyed)) if keyed[r] != keyed[r - 1]]
            out: list[pa.RecordBatch] = []
            for a, z in zip([0, *starts], [*starts, len(keyed)]):
                if held and keyed[a] != now:
                    out.extend(folded(held))
                    held = []
                now = keyed[a]
                held.append(b.slice(a, z - a))
            if out:  # small groups leave as one batch
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if held:
            yield from folded(held)
    return placed.mapInArrow(run, schema)


def next_fit(rows: DataFrame, keys: list[str], order: list[str], item: str, size: str, capacity: int) -> DataFrame:
    """(keys, item, size, batch): items in order; one that would overfill the batch opens the next; an oversized item is alone."""
    def fold(items):
        batch = used = 0
        for _, t in items:
            if used > 0 and used + t > capacity:
                batch, used = batch + 1, 0
            used += t
            yield batch
    return in_order(rows, keys, order, [item, size], "batch", "int", fold)


def limited_batches(batches: DataFrame, calls: int) -> DataFrame:
    """Batches of next_fit() with why they are not sent: one of `calls` is kept back, and one batch is always sent."""
    return batches.withColumn("skipped", F.when(F.col("batch") >= max(1, calls - 1), "model_call_limit"))


def skip_fit(rows: DataFrame, keys: list[str], order: list[str], item: str, size: str, capacity: int, most: int | None = None, first_always: bool = False) -> DataFrame:
    """(keys, item, taken): items in order, each taken if it still fits; one that does not is skipped, later ones may fit. With
    first_always the first is taken whatever its size; after `most` items no more are."""
    def fold(items):
        used = taken = 0
        for _, t in items:
            fits = (most is None or taken < most) and (used + t <= capacity or first_always and not taken)
            used, taken = used + t * fits, taken + fits
            yield fits
    return in_order(rows, keys, order, [item, size], "taken", "boolean", fold).select(*keys, item, "taken")


def select_by_tier(rows: DataFrame, keys: list[str], budget: int, shares: dict[int, float] = V.TIER_SHARES) -> DataFrame:
    """(keys, item, tier, taken) for rows (keys, item, tier, score, size): tier 1 is taken whole; the others fill up to their
    share in order of tier and score, skipping what does not fit; then what is left of the budget goes to the skipped in the same order."""
    caps = {t: int(budget * s) for t, s in shares.items()}

    def fold(items):
        used, spent, taken = 0, dict.fromkeys(caps, 0), []
        for _, tier, size in items:
            take = tier == 1 or spent[tier] + size <= caps[tier] and used + size <= budget
            if take:
                used += size
                spent[tier] = spent.get(tier, 0) + size
            taken.append(take)
        for take, (_, _, size) in zip(taken, items):
            if not take and used + size <= budget:
                take, used = True, used + size
            yield take
    return in_order(rows, keys, ["tier", "-score", "item"], ["item", "tier", "size"], "taken", "boolean", fold).select(*keys, "item", "tier", "taken")


def contained(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, item, tier, first, last) that lie in another span of their group: the first enclosing one by item, and whether
    the inner is dropped (its encloser's tier is at most one worse)."""
    outer = spans.select(*keys, F.col("item").alias("outer"), F.col("tier").alias("outer_tier"), F.col("first").alias("f2"), F.col("last").alias("l2"))
    inside = spans.join(outer, keys).filter("f2 <= first and last <= l2 and not (f2 = first and l2 = last)")
    best = inside.groupBy(*keys, "item", "tier").agg(F.min(F.struct("outer", "outer_tier")).alias("m"))
    return best.select(*keys, "item", F.col("m.outer").alias("outer"), (F.col("m.outer_tier") <= F.col("tier") + 1).alias("dropped"))


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """For each (keys, point) the shortest span (keys, item, first, last) around it, of equals the smallest item."""
    hit = points.join(spans, keys).filter("point between first and last")
    return hit.groupBy(*keys, "point").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("size"), "item")).alias("m")).select(*keys, "point", F.col("m.item").alias("item"))


def capped(rows: DataFrame, outer: list[str], inner: list[str], order: list[Column], per_inner: int, per_outer: int) -> DataFrame:
    """At most per_inner rows of each inner group, then at most per_outer of each outer one, in order."""
    few = rows.withColumn("n", F.row_number().over(W.partitionBy(*outer, *inner).orderBy(*order))).filter(F.col("n") <= per_inner)
    return few.withColumn("n", F.row_number().over(W.partitionBy(*outer).orderBy(*order))).filter(F.col("n") <= per_outer)


def _fold(schema: str, keys: list[str], fold) -> Callable:
    """Batches of (keys..., arrays) -> rows (keys..., values of fold(arrays))."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(i).to_pylist() for i in range(len(keys), b.num_columns)]
            at, out = [], []
            for i, arrays in enumerate(zip(*lists)):
                for values in fold(*arrays):
                    at.append(i)
                    out.append(values)
            cols = list(zip(*out)) if out else [()] * (len(names) - len(keys))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), *(pa.array(c, pa.string()) for c in cols)], names=names)
    return run


def _schema(rows: DataFrame, keys: list[str], *values: str) -> str:
    return ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys] + [f"{v} string" for v in values])


def deduplicate(findings: DataFrame, keys: list[str], near: int = V.ADJACENT_LINES, similar: float = V.SIMILARITY) -> DataFrame:
    """(keys, item, kept_by, confidence, notes) for findings (keys, item, category, first, last, score, confidence, batch, words): by falling
    score each is a duplicate of the first kept one that lies within `near` lines and has its category or enough of its words; kept_by is
    null for the kept, which get the highest confidence of theirs and a note of the batches that found them too. keys must hold the file,
    as only findings of one file are compared."""
    def fold(items):
        kept: list = []
        by: dict = {}
        order = sorted(items, key=lambda r: (-r["score"], r["item"]))
        for r in order:
            words = set(r["words"] or ())
            hit = next((k for k in kept if r["first"] <= k[0]["last"] + near and k[0]["first"] <= r["last"] + near and (
                r["category"] == k[0]["category"] or words and k[1] and len(words & k[1]) >= similar * len(words | k[1]))), None)
            if hit is None:
                kept.append([r, words, r["confidence"], []])
            else:
                by[r["item"]] = hit[0]["item"]
                hit[2] = max(hit[2], r["confidence"])
                hit[3].append(str(r["batch"]))
        mine = {k[0]["item"]: k for k in kept}
        for r in order:
            k = mine.get(r["item"])
            yield r["item"], by.get(r["item"]), str(round(k[2] if k else r["confidence"], 6)), ",".join(k[3]) if k else ""
    schema = _schema(findings, keys, "item", "kept_by", "confidence", "notes")
    g = findings.groupBy(*keys).agg(F.collect_list(F.struct(F.col("item").cast("string").alias("item"), "category", "first", "last", "score", "confidence", "batch", "words")).alias("items"))
    return g.mapInArrow(_fold(schema, keys, fold), schema).withColumn("confidence", F.col("confidence").cast("double"))


def match_in_order(expected: DataFrame, found: DataFrame, keys: list[str], tolerance: int = V.LINE_TOLERANCE) -> DataFrame:
    """(keys, item, matched) for expected (keys, item, first, last): in order of item each takes the first found (keys, item, first,
    last) that lies within the tolerance and is still free. keys hold the case and the file."""
    def fold(want, have):
        free = sorted(have or (), key=lambda r: r["item"])
        for w in sorted(want, key=lambda r: r["item"]):
            hit = next((f for f in free if f["first"] <= w["last"] + tolerance and f["last"] >= w["first"] - tolerance), None)
            if hit is not None:
                free.remove(hit)
            yield w["item"], None if hit is None else hit["item"]
    schema = _schema(expected, keys, "item", "matched")
    row = F.struct(F.col("item").cast("string").alias("item"), "first", "last")
    g = expected.groupBy(*keys).agg(F.collect_list(row).alias("want")).join(found.groupBy(*keys).agg(F.collect_list(row).alias("have")), keys, "left")
    return g.select(*keys, "want", "have").mapInArrow(_fold(schema, keys, fold), schema)
