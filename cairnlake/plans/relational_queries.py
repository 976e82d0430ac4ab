"""Queries: scans, filters, set tests and windows over the project's and the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import classify as C
from cairnlake.operators import search as S
from cairnlake.plans.fold_queries import _P, _lines
from cairnlake.plans.text_queries import _LANG, changed, chunks
from cairnlake.sources.tables import load


def a13_installations(spark, d):
    """Live repositories of each installation."""
    r = load(spark, d, "repositories", "id", "installation_id", "deleted_at").filter("deleted_at is null")
    return r.groupBy("installation_id").agg(F.count("*").alias("repositories"))


def a18_body_limit(spark, d):
    """Patches that a reader with a limit of 2000 bytes takes, refuses, or finds missing."""
    n = F.octet_length("patch")
    p = changed(spark, d, "id", "patch")
    return p.groupBy(F.when(n.isNull(), "missing").when(n <= 2000, "taken").otherwise("refused").alias("outcome")).agg(F.count("*").alias("patches"), F.sum(n.cast("bigint")).alias("bytes"))


def a20_job_files(spark, d):
    """The first files of each job in order of path, with their place."""
    p = changed(spark, d, "id", "review_job_id", "path", "status")
    return S.top(p, ["review_job_id"], [F.col("path"), F.col("id")], 5).select("review_job_id", "rank", "id", "path")


def c8_vector_candidates(spark, d):
    """Chunks with a vector, by model and length."""
    c = load(spark, d, "code_chunks", "id", "embedding_model", "embedding")
    c = c.filter("embedding is not null").select("id", "embedding_model", F.size("embedding").alias("dim")).distinct()
    return c.groupBy("embedding_model", "dim").agg(F.count("*").alias("chunks"))


def c18_triage_reasons(spark, d):
    """Why changed files are passed over: stored reason, removed without a patch, documentation outside the guides."""
    p = changed(spark, d, "id", "path", "status", "patch", "skip_reason")
    low = F.lower("path")
    why = (F.when(F.col("skip_reason").isNotNull(), F.col("skip_reason")).when((F.col("status") == "removed") & F.coalesce(F.col("patch") == "", F.lit(True)), "deleted_file")
           .when((C.language(F.col("path")) == "markdown") & ~(low.startswith("docs/") | low.startswith("readme")), "documentation").otherwise("selected"))
    return p.groupBy(why.alias("reason")).agg(F.count("*").alias("files"))


def i6_whole_ranges(spark, d):
    """Hunks whose new lines were all added."""
    lines = _lines(spark, d).filter("hunk > 0")
    new = lines.filter("new_no is not null").groupBy("id", "hunk").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "add").alias("added"))
    return new.select("id", "hunk", (F.col("lines") == F.col("added")).alias("whole"))


def k5_sliding_windows(spark, d):
    """Counts per type in windows of a day that begin every twelve hours."""
    e = load(spark, d, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "24 hours", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def r_revenue(spark, d):
    """Pricing summary of the order lines."""
    l = load(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


def r_nation_rollup(spark, d):
    """Orders and their value by region and nation of the customer, with subtotals."""
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    o = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(load(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    r = o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return r.select(F.coalesce("r_name", F.lit("(all)")).alias("region"), F.coalesce("n_name", F.lit("(all)")).alias("nation"), "orders", "total")


QUERIES = {f.__name__: f for f in (a13_installations, a18_body_limit, a20_job_files, c8_vector_candidates, c18_triage_reasons, i6_whole_ranges, k5_sliding_windows, r_revenue, r_nation_rollup)}

SQL = {
    "a13_installations": "SELECT installation_id, count(*) AS repositories FROM repositories WHERE deleted_at IS NULL GROUP BY 1",
    "a18_body_limit": """SELECT CASE WHEN patch IS NULL THEN 'missing' WHEN octet_length(encode(patch)) <= 2000 THEN 'taken' ELSE 'refused' END AS outcome, count(*) AS patches, sum(octet_length(encode(patch)))::BIGINT AS bytes
        FROM (SELECT DISTINCT id, patch FROM changed_files) GROUP BY 1""",
    "a20_job_files": """SELECT review_job_id, rank, id, path FROM (SELECT *, row_number() OVER (PARTITION BY review_job_id ORDER BY path, id)::INT AS rank FROM (SELECT DISTINCT id, review_job_id, path FROM changed_files)) WHERE rank <= 5""",
    "c8_vector_candidates": "SELECT embedding_model, dim, count(*) AS chunks FROM (SELECT DISTINCT id, embedding_model, len(embedding)::INT AS dim FROM code_chunks WHERE embedding IS NOT NULL) GROUP BY ALL",
    "c18_triage_reasons": f"""SELECT CASE WHEN skip_reason IS NOT NULL THEN skip_reason WHEN status = 'removed' AND coalesce(patch = '', true) THEN 'deleted_file'
        WHEN ({_LANG}) = 'markdown' AND NOT (lower(path) LIKE 'docs/%' OR lower(path) LIKE 'readme%') THEN 'documentation' ELSE 'selected' END AS reason, count(*) AS files
        FROM (SELECT DISTINCT id, path, status, patch, skip_reason FROM changed_files) GROUP BY 1""",
    "i6_whole_ranges": f"WITH {_P} SELECT id, hunk::INT AS hunk, count(*) = count(*) FILTER (WHERE kind = 'add') AS whole FROM l WHERE new_no IS NOT NULL GROUP BY ALL",
    "k5_sliding_windows": """SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 12 HOURS AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL""",
    "r_revenue": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "r_nation_rollup": """SELECT coalesce(r_name, '(all)') AS region, coalesce(n_name, '(all)') AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""",
}
