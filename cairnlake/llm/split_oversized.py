"""Splitting oversized items at natural boundaries.

Every position of a text has a boundary strength (blank line, block start, line end, sentence end, word end,
nothing). A sparse table over the strengths answers range-maximum queries in constant time: each piece is cut
at the strongest position of its permissible length window, ties broken rightward, and the next piece begins
`overlap` characters before the cut, moved right to a line or word start if there is one in the overlap.

Sizes are tokens by the project's estimate, max(1, characters // 4), characters being Unicode code points.

Defined results
- null or empty content: one piece, of zero tokens, unchanged. Items within the limit: one piece, unchanged.
- null start_line counts as 1. end_line is counted from the content, whatever the row says.
- a text without any boundary is cut at the limit, but never within CRLF.
- repeated rows of an id give one set of pieces; of rows that differ under an id one over the limit holds, of several the greatest
  (start_line, content). Extra columns are ignored. Every different row without an id is an item of its own, of id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 800, 80, 4
#: Shares of the limit between which a cut may lie.
MIN_SHARE = 0.5
SEGMENT = 1 << 16

SCHEMA = ("item_id string, piece_no int, n_pieces int, start_char bigint, end_char bigint, start_line int, end_line int, "
          "token_count int, content string")


def estimated_tokens(text: Column) -> Column:
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / CHARS_PER_TOKEN).cast("int")))


def strengths(text: str) -> np.ndarray:
    """Strength 0..9 of a cut before each position 0..len(text); -1 where none may be."""
    n = len(text)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(n + 1, np.int64)
    nl = cp == 10
    space = (cp == 32) | (cp == 9)
    out[1:][space] = 1
    stop = np.isin(cp, (46, 33, 63, 59, 0x3002))  # . ! ? ; and the ideographic full stop
    out[1:-1][stop[:-1] & (space | nl)[1:]] = 2
    ends = np.flatnonzero(nl) + 1
    if len(ends):
        # indentation and first character of the line that begins at each line end
        starts = ends[ends < n]
        filled = np.flatnonzero(~(space | nl | (cp == 13)))
        at = np.searchsorted(filled, starts)
        first = np.where(at < len(filled), filled[np.minimum(at, max(len(filled) - 1, 0))] if len(filled) else n, n)
        next_nl = np.append(np.flatnonzero(nl), n)[np.searchsorted(np.flatnonzero(nl), starts)]
        blank = first >= next_nl  # the line that begins here is empty
        indent = np.where(blank, 99, first - starts)
        out[ends] = 3
        out[starts] = np.where(blank, 3, np.maximum(4, 7 - np.minimum(indent, 12) // 4))
        prev_blank = np.zeros(len(starts), bool)
        prev_blank[1:] = blank[:-1] & (starts[1:] - starts[:-1] <= 2 + np.where(blank[:-1], next_nl[:-1] - starts[:-1], 0))
        lead = text[:1]
        if lead == "\n" and len(starts):
            prev_blank[0] = True
        out[starts] += np.where(prev_blank & ~blank, 2, 0)
    crlf = (cp[:-1] == 13) & (cp[1:] == 10) if n > 1 else np.zeros(0, bool)
    out[1:-1][crlf] = -1
    out[n] = 9
    return out


class RangeMax:
    """Sparse table over keys; query(lo, hi) gives the position of the greatest strength in [lo, hi], the rightmost of equals."""

    def __init__(self, strength: np.ndarray, widest: int):
        n = len(strength)
        self.n = n
        level = (strength + 1) * np.int64(n) + np.arange(n)
        self.levels = [level]
        step = 1
        while step * 2 <= min(widest, n):
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def query(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[lo], row[hi - (1 << k) + 1]) % self.n)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text longer than limit characters. limit > 2 * overlap >= 0."""
    low = max(int(limit * MIN_SHARE), overlap + 1)
    n, out, start = len(text), [], 0
    base, table = -1, None
    while n - start > limit:
        if table is None or start + limit >= base + SEGMENT + limit:
            base = start
            # one character more on each side, so that strengths at the rim are those of the whole text
            a, b = max(0, base - 1), min(n, base + SEGMENT + limit + 400)
            s = strengths(text[a:b])[base - a:]
            if b < n:
                s[-1] = 0
            table = RangeMax(s, limit)
        end = base + table.query(start + low - base, start + limit - base)
        out.append((start, end))
        begin = end - overlap
        if overlap:
            # the leftmost line start within the overlap, else the leftmost word start
            nl = text.find("\n", begin - 1, end - 1)
            if nl >= 0:
                begin = nl + 1
            else:
                ws = next((i for i in range(begin, end) if text[i - 1] in " \t" and text[i] not in " \t\r\n"), begin)
                begin = ws
            if text[begin - 1:begin + 1] == "\r\n":
                begin += 1
        start = max(begin, start + 1)
    out.append((start, n))
    return out


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for key, line, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                spans = cut(text, limit, overlap)
                seen, at = 0, 0
                for k, (s, e) in enumerate(spans, 1):
                    # newlines before s, counted onward from the piece before
                    seen += text.count("\n", at, s) if s >= at else -text.count("\n", s, at)
                    at = s
                    piece = text[s:e]
                    inner = piece.count("\n") - piece.endswith("\n")
                    row = (key, k, len(spans), s, e, line + seen, line + seen + inner,
                           max(1, len(piece) // CHARS_PER_TOKEN), piece)
                    for c, v in zip(cols, row):
                        c.append(v)
                    if len(cols[0]) >= 2000:
                        yield _batch(cols)
                        cols = [[] for _ in range(9)]
            if cols[0]:
                yield _batch(cols)
    return run


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def split(items: DataFrame, *, key: str = "id", content: str = "content", start_line: str | None = "start_line",
          max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, keep_small: bool = True) -> DataFrame:
    """Pieces of every item (SCHEMA). With keep_small=False only those of items over the limit.

    Only texts over the limit reach Python; the others are passed through in the JVM.
    """
    limit, overlap = max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1, overlap_tokens * CHARS_PER_TOKEN
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be under half the limit")
    line = F.col(start_line).cast("int") if start_line else F.lit(1)
    rows = items.select(F.col(key).cast("string").alias("item_id"), F.coalesce(line, F.lit(1)).alias("line"), F.col(content).alias("text"))
    rows = rows.withColumn("over", F.coalesce(F.length("text") > limit, F.lit(False)))
    if not keep_small:
        rows = rows.filter("over")
    # a row without an id is an item of its own
    own = F.when(F.col("item_id").isNull(), F.struct("line", "text")).alias("own")
    # one shuffle, which both branches below read
    one = rows.groupBy("item_id", own).agg(F.max(F.struct("over", "line", "text")).alias("r")).select("item_id", "r.over", "r.line", "r.text")
    out = one.filter("over").select("item_id", "line", "text").mapInArrow(_pieces(limit, overlap), SCHEMA)
    if not keep_small:
        return out
    small = one.filter("not over")
    n = F.length("text")
    inner = n - F.length(F.regexp_replace("text", "\n", "")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
    return out.unionByName(small.select(
        "item_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("bigint").alias("start_char"),
        F.coalesce(n, F.lit(0)).cast("bigint").alias("end_char"), F.col("line").alias("start_line"),
        (F.col("line") + F.coalesce(inner, F.lit(0))).cast("int").alias("end_line"),
        F.coalesce(estimated_tokens(F.col("text")), F.lit(0)).alias("token_count"), F.col("text").alias("content")))
