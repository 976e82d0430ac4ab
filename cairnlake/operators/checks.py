"""Checks of rows against rules, each with the reason why a row fails; signatures; small reports."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """Name of the first rule that a row breaks (its column not true), null if it keeps all."""
    out = None
    for name, ok in rules.items():
        broken = ~F.coalesce(ok, F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out if out is not None else F.lit(None).cast("string")


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with column reason)."""
    r = rows.withColumn("reason", reasons(rules))
    return r.filter("reason is null").drop("reason"), r.filter("reason is not null")


def snap(findings: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (keys, item, first, last) moved onto lines (keys, n) that exist: the run of lines around the first line, else around the
    last one, cut to the finding. Findings that touch no line are left out. The runs come from gaps between sorted numbers."""
    from cairnlake.operators.diff import ranges

    runs = ranges(lines, keys, "n")
    hit = findings.join(runs, keys)
    at_first = F.col("first").between(F.col("range_start"), F.col("range_end"))
    at_last = F.col("last").between(F.col("range_start"), F.col("range_end"))
    best = hit.filter(at_first | at_last).groupBy(*keys, "item", "first", "last").agg(F.min(F.struct((~at_first).alias("o"), "range_start", "range_end")).alias("r"))
    return best.select(*keys, "item", F.greatest("first", "r.range_start").alias("low"), F.least("last", "r.range_end").alias("high"))


def signed(body: Column, secret: str, signature: Column) -> Column:
    """Whether signature is 'sha256=' and the HMAC-SHA256 of body, compared in constant time."""
    key = secret.encode()

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, signs in batches:
            yield pd.Series([b is not None and s is not None and hmac.compare_digest("sha256=" + hmac.new(key, b.encode(), hashlib.sha256).hexdigest(), s) for b, s in zip(bodies, signs)])
    return run(body, signature)


def signature(body: Column, secret: str) -> Column:
    """'sha256=' and the HMAC-SHA256 of body."""
    key = secret.encode()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield pd.Series([None if b is None else "sha256=" + hmac.new(key, b.encode(), hashlib.sha256).hexdigest() for b in bodies])
    return run(body)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; of a larger one the first `most` rows and a line that says so."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = [[cell(v) for v in r] for r in rows.limit(most + 1).collect()]
    body, cut = body[:most], len(body) > most
    return "\n".join("| " + " | ".join(x) + " |" for x in [rows.columns, ["---"] * len(rows.columns), *body]) + (f"\n\nOnly the first {most} rows are shown." if cut else "")
