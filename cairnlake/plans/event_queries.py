"""Queries: events and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import events as E
from cairnlake.sources.tables import load
from cairnlake.streaming import events as S


def _events(spark, d, *cols):
    return load(spark, d, "events", "event_id", "ts", *cols)


def _jobs(spark, d, *cols):
    return load(spark, d, "review_jobs", "id", *cols).distinct()


def g14_rate_limit(spark, d):
    return E.rate_limited(_events(spark, d, "user_id"), "user_id", 3600, 1, "event_id").select("event_id", "nth", "blocked")


def f6_rolling_spend(spark, d):
    v = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    return E.rolling_sum(_events(spark, d, "user_id", "event_type", "value"), "user_id", v, 24, "event_id").select("event_id", F.round("rolling", 4).alias("spent"))


def k_sessions(spark, d):
    return E.sessions(_events(spark, d, "user_id"), "user_id", "30 minutes")


def f15_quantiles(spark, d):
    e = _events(spark, d, "event_type", "value")
    q = E.quantiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    highest = e.groupBy("event_type").agg(F.max("value").alias("highest"))
    return q.join(highest, "event_type").select("event_type", *[F.round(n, 6).alias(n) for n in ("p50", "p95", "p99", "highest")])


def j33_histogram(spark, d):
    return E.histogram(_events(spark, d, "value"), F.col("value"), [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0])


def g13_superseded(spark, d):
    return E.superseded(_jobs(spark, d, "repository_id", "pull_number", "created_at"))


def g12_durations(spark, d):
    """Seconds that jobs waited and ran, by status."""
    j = _jobs(spark, d, "status", "created_at", "started_at", "finished_at")
    wait = (E.epoch(F.col("started_at")) - E.epoch(F.col("created_at"))) / 1e6
    ran = (E.epoch(F.col("finished_at")) - E.epoch(F.col("started_at"))) / 1e6
    return j.groupBy("status").agg(F.count("*").alias("jobs"), F.round(F.avg(wait), 3).alias("waited"), F.round(F.avg(ran), 3).alias("ran"), F.count(ran).alias("finished"))


def f9_status_histogram(spark, d):
    return _jobs(spark, d, "trigger", "status").groupBy("trigger", "status").agg(F.count("*").alias("jobs"))


def c6_window_counts(spark, d):
    """Hourly counts and sums per event type."""
    e = _events(spark, d, "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def b13_retained(spark, d):
    """Events of the last seven days of the table, per type."""
    e = _events(spark, d, "event_type")
    last = e.agg(F.max("ts")).first()[0]  # one value, which then reaches the scan
    return e.filter(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("events"))


def k1_stream_deduplicated(spark, d):
    """The stream of events, each of which arrives twice, without repeated ids: counted per type."""
    twice = S.read(spark, d).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return S.run(S.deduplicated(twice, "event_id", "1 day"), "dedup").groupBy("event_type").agg(F.count("*").alias("events"))


def k4_stream_windows(spark, d):
    """Tumbling hourly counts of the stream."""
    out = S.run(S.windowed(S.read(spark, d), "1 hour", "1 day"), "windows", mode="complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def k2_stream_latest(spark, d):
    """Stateful stream: per user how many events superseded an earlier one within an hour."""
    return S.run(S.superseding(S.read(spark, d), 3600), "latest").groupBy("user_id").agg(F.sum("superseded").alias("superseded"), F.sum("seen").alias("events"))


QUERIES = {f.__name__: f for f in (g14_rate_limit, f6_rolling_spend, k_sessions, f15_quantiles, j33_histogram, g13_superseded, g12_durations, f9_status_histogram, c6_window_counts, b13_retained,
                                   k1_stream_deduplicated, k4_stream_windows, k2_stream_latest)}

SQL = {
    "g14_rate_limit": """SELECT event_id, nth, nth > 1 AS blocked FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id)::INT AS nth FROM events)""",
    "f6_rolling_spend": """SELECT event_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), 4) AS spent FROM events""",
    "k_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s, event_id FROM events),
        b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM a) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM b GROUP BY user_id, n""",
    "f15_quantiles": """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS highest FROM events GROUP BY 1""",
    "j33_histogram": "SELECT le, count(*) FILTER (WHERE value <= b) AS observations FROM events, (VALUES ('1.0', 1.0), ('5.0', 5.0), ('10.0', 10.0), ('25.0', 25.0), ('50.0', 50.0), ('100.0', 100.0), ('250.0', 250.0), ('+Inf', 1e300)) v(le, b) GROUP BY le",
    "g13_superseded": """SELECT id, "by" FROM (SELECT id, lead(id) OVER (PARTITION BY repository_id, pull_number ORDER BY created_at, id) AS "by" FROM (SELECT DISTINCT id, repository_id, pull_number, created_at FROM review_jobs)) WHERE "by" IS NOT NULL""",
    "g12_durations": """SELECT status, count(*) AS jobs, round(avg((epoch_us(started_at) - epoch_us(created_at)) / 1e6), 3) AS waited, round(avg((epoch_us(finished_at) - epoch_us(started_at)) / 1e6), 3) AS ran,
        count(epoch_us(finished_at) - epoch_us(started_at)) AS finished FROM (SELECT DISTINCT id, status, created_at, started_at, finished_at FROM review_jobs) GROUP BY 1""",
    "f9_status_histogram": 'SELECT "trigger", status, count(DISTINCT id) AS jobs FROM review_jobs GROUP BY ALL',
    "c6_window_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "b13_retained": "SELECT event_type, count(*) AS events FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY 1",
    "k1_stream_deduplicated": "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
    "k2_stream_latest": """SELECT user_id, sum(CASE WHEN epoch_us(ts) - epoch_us(p) <= 3600000000 THEN 1 ELSE 0 END)::BIGINT AS superseded, count(*)::BIGINT AS events
        FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) GROUP BY 1""",
    "k4_stream_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
