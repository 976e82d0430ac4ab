"""Unified diffs: hunks, numbered lines and ranges of lines.

parse() is a table function over patches. A patch is malformed if it has text before its first hunk header, a line
of no known kind, or line counts other than its headers say; it then gives one row with hunk 0 and the reason.
Null and empty patches give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)")
LINES = "id string, hunk int, old_start int, old_len int, new_start int, new_len int, line int, kind string, old_no int, new_no int, text string, problem string"
_TYPES = {"string": pa.string(), "int": pa.int32()}


def read_patch(patch: str) -> tuple[list[tuple], str | None]:
    """Rows (hunk, four numbers of its header, line, kind, old_no, new_no, text), or the reason why there are none."""
    raw = patch.split("\n")
    out: list[tuple] = []
    at, hunk = 0, 0
    while at < len(raw) and not raw[at].strip():
        at += 1
    while at < len(raw):
        m = HEADER.fullmatch(raw[at])
        if not m:
            return [], "text before the first hunk" if not hunk else "unknown line"
        hunk += 1
        old, new = int(m[1]), int(m[3])
        head = (old, int(m[2] or 1), new, int(m[4] or 1))
        rows: list[tuple] = []
        at += 1
        while at < len(raw) and not raw[at].startswith("@@ "):
            x = raw[at]
            at += 1
            sign = x[:1]
            if sign == "\\":
                continue
            if sign == "+":
                rows.append((hunk, *head, len(rows) + 1, "add", None, new, x[1:]))
                new += 1
            elif sign == "-":
                rows.append((hunk, *head, len(rows) + 1, "del", old, None, x[1:]))
                old += 1
            elif sign in (" ", ""):
                rows.append((hunk, *head, len(rows) + 1, "context", old, new, x[1:]))
                old, new = old + 1, new + 1
            else:
                return [], "unknown line"
        # the empty piece behind a final line break is no line
        if at >= len(raw) and rows and rows[-1][6] == "context" and rows[-1][9] == "" and (old - head[0] > head[1] or new - head[2] > head[3]):
            rows.pop()
            old, new = old - 1, new - 1
        if (old - head[0], new - head[2]) != (head[1], head[3]):
            return [], "line counts"
        out += rows
    return out, None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in LINES.split(", ")))
    for b in batches:
        rows: list[tuple] = []
        for key, patch in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got, problem = read_patch(patch) if patch else ([], None)
            rows += [(key, *r, None) for r in got]
            if problem:
                rows.append((key, 0, *(None,) * 9, problem))
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(cols, kinds)], names=list(names))


def parse(rows: DataFrame, *, row_id: str = "id", patch: str = "patch") -> DataFrame:
    """One row per line of each hunk (LINES)."""
    return rows.select(F.col(row_id).cast("string").alias("id"), F.col(patch).alias("patch")).mapInArrow(_parse, LINES)


def hunks(lines: DataFrame) -> DataFrame:
    """One row per hunk with its counts by kind."""
    return lines.filter("hunk > 0").groupBy("id", "hunk", "old_start", "old_len", "new_start", "new_len").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("add", "added"), ("del", "removed"), ("context", "context"))])


def ranges(lines: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers per key: (keys, range_start, range_end). Keys are files, so groups are bounded by a file."""
    n = lines.select(*keys, F.col(number).alias("n")).filter("n is not null").distinct()
    island = F.col("n") - F.row_number().over(W.partitionBy(*keys).orderBy("n"))
    return n.withColumn("island", island).groupBy(*keys, "island").agg(F.min("n").alias("range_start"), F.max("n").alias("range_end")).drop("island")


def gutter(kind: Column, old_no: Column, new_no: Column, text: Column) -> Column:
    """A line as a reader sees it, numbers right-aligned."""
    return (F.when(kind == "add", F.concat(F.lpad(new_no.cast("string"), 6, " "), F.lit(" +     | "), text))
            .when(kind == "del", F.concat(F.lpad(F.concat(F.lit("-"), old_no.cast("string")), 6, " "), F.lit("       | "), text))
            .otherwise(F.concat(F.lpad(new_no.cast("string"), 6, " "), F.lit("       | "), text)))


def render(lines: DataFrame) -> DataFrame:
    """(id, text): each patch with numbered lines; a patch is one group."""
    one = lines.filter("hunk > 0").select("id", F.struct("hunk", "line", gutter(F.col("kind"), F.col("old_no"), F.col("new_no"), F.col("text")).alias("t")).alias("r"))
    return one.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").alias("text"))
