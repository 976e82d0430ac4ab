"""Event and job analytics: limits, rolling sums, sessions, durations, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rate_limited(events: DataFrame, key: str, seconds: int, limit: int, order: str) -> DataFrame:
    """Each event's number within its key's fixed window and whether it is over the limit; blocked ones count too."""
    bucket = F.floor(epoch(F.col("ts")) / (seconds * 1_000_000)).alias("bucket")
    e = events.withColumn("bucket", bucket)
    return e.withColumn("nth", F.row_number().over(W.partitionBy(key, "bucket").orderBy("ts", order))).withColumn("blocked", F.col("nth") > limit)


def rolling_sum(events: DataFrame, key: str, value: Column, hours: int, order: str) -> DataFrame:
    """Sum of value over each event's key and the `hours` up to it. A key's history is cut into pieces of that length, each
    event going to its own piece and, as a helper, to the next: no task holds a whole key."""
    micros = hours * 3_600_000_000
    e = events.withColumn("_t", epoch(F.col("ts"))).withColumn("_v", value).withColumn("_p", F.floor(F.col("_t") / micros))
    both = e.withColumn("_own", F.lit(True)).unionByName(e.withColumn("_p", F.col("_p") + 1).withColumn("_own", F.lit(False)))
    w = W.partitionBy(key, "_p").orderBy("_t").rangeBetween(-micros, 0)
    return both.withColumn("rolling", F.sum("_v").over(w)).filter("_own").drop("_t", "_v", "_p", "_own")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, events): runs of events with no gap as long as `gap`."""
    s = events.withColumn("_t", F.col("ts").cast("timestamp")).groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("events"), F.max("_t").alias("last"))
    return s.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("session_end"), "events")


def histogram(rows: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """(le, observations): cumulative counts up to each bound, and of all."""
    counts = rows.agg(*[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("observations")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("observations")))
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def superseded(jobs: DataFrame) -> DataFrame:
    """Jobs of a pull request that a later job follows: (id, by)."""
    w = W.partitionBy("repository_id", "pull_number").orderBy("created_at", "id")
    return jobs.withColumn("by", F.lead("id").over(w)).filter("by is not null").select("id", "by")


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], accuracy: int = 1_000) -> DataFrame:
    """(by, <name>...): exact quantiles of each group, interpolated between neighbours, without any group in one task.

    A sketch gives bounds between which each quantile lies; what is below them is only counted, and the values between
    are sorted: a share of about 4 / accuracy of the rows for each quantile, or the whole of a group of up to 10 * accuracy rows,
    whose ranks lie too close for a sketch.
    """
    r = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    eps = 2.0 / accuracy
    edges = sorted({min(1.0, max(0.0, p + s)) for p in shares.values() for s in (-eps, eps)})
    sketch = r.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", edges, accuracy * 10).alias("e"))
    names = list(shares)
    small = F.col("n") <= 10 * accuracy
    edge = lambda p, all_: F.when(small, float(all_)).otherwise(F.col("e")[edges.index(p)])
    spans = F.array(*[F.struct(F.lit(k).alias("k"), edge(max(0.0, p - eps), "-inf").alias("low"), edge(min(1.0, p + eps), "inf").alias("high"), ((F.col("n") - 1) * p).alias("at"))
                      for k, p in enumerate(shares.values())])
    s = sketch.select("g", F.explode(spans).alias("s")).select("g", "s.*")
    met = r.join(F.broadcast(s), "g")  # one row per group and quantile
    below = met.filter("v < low").groupBy("g", "k").agg(F.count("*").alias("below"))
    between = met.filter("v >= low and v <= high").groupBy("g", "k", "at", "v").agg(F.count("*").alias("c"))
    upto = W.partitionBy("g", "k").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = between.join(below, ["g", "k"], "left").withColumn("last", F.coalesce("below", F.lit(0)) + F.sum("c").over(upto) - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    # the values at the two whole positions around `at`
    lo, hi = F.floor("at"), F.ceil("at")
    at = lambda p: F.max(F.when((F.col("first") <= p) & (F.col("last") >= p), F.col("v")))
    q = ranked.groupBy("g", "k", "at").agg(at(lo).alias("a"), at(hi).alias("b")).withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return q.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in enumerate(names)])
