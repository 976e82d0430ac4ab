"""Queries: findings, their checks and joins, insertions that skip what is there.

The tables hold no findings; a changed file stands for one: its id, job, path and status, a severity from its id, a confidence and lines from
its counts. The SQL builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.functions import fixed_values as V, text as T
from cairnlake.operators import checks as K, index as I, review as R, search as S
from cairnlake.plans.text_queries import _GEN, changed, chunks
from cairnlake.sources.tables import load

FILE = ["repository_id", "blob_sha", "chunker_version"]


def findings(spark: SparkSession, d: str) -> DataFrame:
    p = changed(spark, d, "id", "review_job_id", "repository_id", "pull_number", "path", "status", "additions", "deletions")
    return p.select("id", F.col("review_job_id").alias("job"), "repository_id", "pull_number", "path", F.col("status").alias("category"), (F.ascii(F.substring("id", 1, 1)) % 4).alias("severity"),
                    (((F.col("additions") * 7 + F.col("deletions") * 13) % 100) / 100.0).alias("confidence"), (F.col("additions") + 1).alias("first"), (F.col("additions") + 1 + F.col("deletions") % 40).alias("last"))


def h7_finding_rank(spark, d):
    return R.ranked(findings(spark, d), ["job"], R.by_rank()).select("id", "position")


def h8_publish_order(spark, d):
    return R.ranked(findings(spark, d), ["job"], R.by_publishing()).select("id", "position")


def f8_overall_risk(spark, d):
    """The highest severity of each job."""
    r = findings(spark, d).groupBy("job").agg(F.max("severity").alias("s"))
    return r.select("job", F.element_at(F.array(*[F.lit(x) for x in R.SEVERITIES]), F.col("s") + 1).alias("risk"))


def f7_usage_ledger(spark, d):
    j = load(spark, d, "review_jobs", "id", "repository_id", "pull_number", "usage", "created_at").distinct()
    get = lambda k: F.expr(f"coalesce(try_cast(get_json_object(usage, '$.{k}') as bigint), 0)")
    return R.usage_ledger(j.select("id", "repository_id", "pull_number", "created_at", get("input_tokens").alias("input"), get("output_tokens").alias("output")), ["repository_id", "pull_number"], 3)


def d21_verdicts(spark, d):
    """Findings left after verdicts by number within the job; some verdicts name numbers that no finding has."""
    f = findings(spark, d)
    numbered = R.ranked(f, ["job"], [F.col("id")]).withColumn("n", F.col("position") - 1)
    told = f.select("job", (F.col("last") % 9).alias("n"), (F.col("severity") > 0).alias("keep"))
    return R.with_verdicts(numbered, told).select("id", "job", "n")


def d19_references(spark, d):
    f = findings(spark, d).withColumn("refs", F.array_distinct(F.array(F.concat(F.lit("ctx-"), F.col("first") % 5), F.concat(F.lit("ctx-"), F.col("last") % 7))))
    known = f.groupBy("job").agg(F.array_agg(F.concat(F.lit("ctx-"), F.col("severity"))).alias("known"))
    return R.checked_references(f, known).select("id", F.array_join(F.array_sort("unknown"), ",").alias("unknown"), "confidence")


def d20_reference_labels(spark, d):
    """Where the class of each method stands."""
    c = chunks(spark, d, "id", *FILE, "path", "symbol_type", "qualified_name", "parent_symbol", "start_line", "end_line")
    k = c.filter("symbol_type = 'class'").select(*FILE, F.col("qualified_name").alias("parent_symbol"), F.col("id").alias("ref"))
    return R.reference_labels(c.filter("symbol_type = 'method'").join(k, [*FILE, "parent_symbol"]).select("id", "ref"), c)


def _marks(f: DataFrame) -> DataFrame:
    return f.withColumn("fingerprint", F.md5(F.concat_ws("|", "repository_id", "pull_number", "path", "category")))


def _posted(f: DataFrame) -> DataFrame:
    return f.filter("severity = 3").select("fingerprint", F.col("job").alias("posted_by"))


def d22_fresh_comments(spark, d):
    """Findings whose fingerprint was not posted yet; what is critical has been."""
    f = _marks(findings(spark, d))
    return f.filter("severity < 3").join(_posted(f), "fingerprint", "left_anti").select("id", "fingerprint")


def d23_comment_ids(spark, d):
    """The comment that bears each finding's fingerprint in the same job, if there is one."""
    f = _marks(findings(spark, d))
    posted = f.filter("severity = 3").groupBy("fingerprint", "job").agg(F.min("id").alias("comment_id"))
    return f.join(posted, ["fingerprint", "job"], "left").select("id", "comment_id")


def b2_new_deliveries(spark, d):
    """Deliveries of manual jobs and comments that none of the webhook's had brought."""
    j = load(spark, d, "review_jobs", "delivery_id", "trigger").filter("delivery_id is not null").distinct()
    hooks = j.filter("trigger = 'webhook'").select("delivery_id")
    return I.insert_new(hooks, j.filter("trigger <> 'webhook'").select("delivery_id"), ["delivery_id"])


def b4_inserted_chunks(spark, d):
    """Chunks that are new beside those of the old chunker, by identity, null being equal to null; how many per repository."""
    key = ["repository_id", "blob_sha", "start_line", "symbol_type", "qualified_name"]
    c = chunks(spark, d, "id", "chunker_version", *key)
    fresh = I.insert_new(c.filter("chunker_version = '0'").select(*key), c.filter("chunker_version = '1'").select(*key), key)
    return fresh.groupBy("repository_id").agg(F.count("*").alias("inserted"))


def b5_cache_inserts(spark, d):
    """Keys of embedded chunks that the cache does not hold, every tenth hash having been evicted from it."""
    key = ["content_hash", "embedding_model"]
    have = load(spark, d, "embedding_cache", *key).filter(~F.col("content_hash").startswith("a"))
    return I.insert_new(have, chunks(spark, d, "id", *key).filter("embedding_model is not null").select(*key), key)


def _naming(c: DataFrame) -> DataFrame:
    """Chunks that also count as naming themselves: the called names of the data are defined nowhere in it."""
    return c.withColumn("called_names", F.array_compact(F.array_append("called_names", F.col("symbol"))))


def d14_calls_within_changes(spark, d):
    """Functions and classes that a chunk names without a dot and another chunk of the change, here the whole repository, defines."""
    c = _naming(chunks(spark, d, "id", "repository_id", "symbol", "symbol_type", "qualified_name", "called_names"))
    bare = c.select("repository_id", "id", F.explode(F.array_distinct("called_names")).alias("qualified_name")).filter(~F.col("qualified_name").contains("."))
    defs = c.filter(F.col("symbol_type").isin("function", "class")).select("repository_id", "qualified_name", F.col("id").alias("target"))
    return bare.join(defs, ["repository_id", "qualified_name"]).filter("id <> target").select("id", "target")


def d15_sibling_calls(spark, d):
    """Calls between the methods of a class; a method's reach of self is taken to be every name it could be reached by."""
    c = chunks(spark, d, "id", *FILE, "symbol", "symbol_type", "parent_symbol", "called_names")
    names = c.filter("symbol_type = 'method'").groupBy(*FILE, "parent_symbol").agg(F.collect_set("symbol").alias("s"))
    m = c.join(names, [*FILE, "parent_symbol"], "left").withColumn("called_names", F.concat("called_names", F.transform(F.coalesce("s", F.array().cast("array<string>")), lambda x: F.concat(F.lit("self."), x))))
    return R.sibling_calls(m, FILE)


def d16_alias_calls(spark, d):
    """Calls of module.name, module being the stem of another Python file of the repository, name a definition there."""
    c = _naming(chunks(spark, d, "id", "repository_id", "path", "language", "symbol", "symbol_type", "called_names").filter("language = 'python'"))
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    files = c.select("repository_id", "path", stem.alias("alias")).distinct()
    # the calls of the data are bare; each is also tried behind the stem of every file that defines the name
    owners = c.filter(F.col("symbol_type").isin("function", "class")).select("repository_id", F.col("symbol").alias("name"), stem.alias("alias")).distinct()
    dotted = (c.select("repository_id", "id", F.explode("called_names").alias("name")).join(owners, ["repository_id", "name"])
              .groupBy("repository_id", "id").agg(F.collect_set(F.concat_ws(".", "alias", "name")).alias("called_names"), F.collect_set("alias").alias("aliases")))
    calls = c.drop("called_names").join(dotted, ["repository_id", "id"], "left").withColumn("called_names", F.coalesce("called_names", F.array().cast("array<string>")))
    imports = dotted.select("repository_id", "id", F.explode("aliases").alias("alias")).join(files, ["repository_id", "alias"])
    return R.alias_calls(calls, imports).distinct()


def f4_merged_spans(spark, d):
    """Chunks that different chunker versions or kinds give for the same span of a file."""
    c = chunks(spark, d, "id", "repository_id", "blob_sha", "path", "chunker_version", "symbol_type", "start_line", "end_line", "token_count")
    rows = c.select("repository_id", "blob_sha", "start_line", "end_line", (2 - F.col("chunker_version").cast("int")).alias("tier"), F.col("token_count").cast("double").alias("score"),
                    F.concat_ws(":", "symbol_type", "chunker_version").alias("reason"), F.col("id").alias("position"))
    return R.merged_spans(rows, ["repository_id", "blob_sha", "start_line", "end_line"])


def i3_shared_names(spark, d):
    """Of the names a test calls those that code of its repository defines, in order of their first mention."""
    c = _naming(chunks(spark, d, "id", "repository_id", "symbol", "symbol_type", "called_names", "is_test"))
    names = c.filter("is_test").select("repository_id", F.explode("called_names").alias("symbol")).distinct()
    defined = c.filter(~F.col("is_test") & F.col("symbol_type").isin(*S.DEFINITIONS)).join(names, ["repository_id", "symbol"], "left_semi").groupBy("repository_id").agg(F.collect_set("symbol").alias("defined"))
    t = c.filter("is_test").join(defined, "repository_id", "left")
    return t.select("id", F.array_join(F.array_intersect("called_names", F.coalesce("defined", F.array().cast("array<string>"))), ",").alias("names"))


def j12_code_tokens(spark, d):
    """Tokens of each patch's first lines behind a gutter, collapsed."""
    p = changed(spark, d, "id", "patch").filter("patch is not null")
    line = F.concat(F.lit(" 12 + | "), F.regexp_extract("patch", "\n(.*)", 1))
    return p.select("id", F.array_join(R.code_tokens(T.collapse(R.strip_gutter(line))), " ").alias("tokens"))


def j13_normalized_paths(spark, d):
    """Paths as they come back from a reader, quoted and with prefixes, and the file of the job they mean."""
    p = changed(spark, d, "id", "review_job_id", "path")
    known = p.groupBy("review_job_id").agg(F.collect_set("path").alias("known"))
    k = F.ascii(F.substring("id", 2, 1)) % 5
    told = F.when(k == 0, F.concat(F.lit(" `./"), F.col("path"), F.lit("` "))).when(k == 1, F.concat(F.lit("'a/"), F.col("path"), F.lit("'"))).when(k == 2, F.concat(F.lit("b/"), F.col("path"))).when(
        k == 3, F.concat(F.lit("x/"), F.col("path"))).otherwise(F.col("path"))
    return p.join(known, "review_job_id").select("id", R.normalized_path(told, F.col("known")).alias("path"))


def j29_evidence(spark, d):
    """How a chunk's signature, its last word cut and another put in front, is found in its content."""
    c = chunks(spark, d, "id", "signature", "content").filter("signature is not null and content is not null")
    k = F.ascii(F.substring("id", 1, 1)) % 4
    quote = F.when(k == 0, F.col("signature")).when(k == 1, F.concat(F.lit("9 + | see "), F.regexp_replace("signature", r"[(,):]", " ; "))).when(k == 2, F.expr("substring(signature, 1, 5)")).otherwise(F.concat("signature", F.lit(" ?? other things here")))
    return c.select("id", R.evidence(quote, F.col("content")).alias("match"))


def j30_replacements(spark, d):
    """Why a replacement of the finding's lines by the first lines of the patch could not be offered."""
    p = changed(spark, d, "id", "patch", "additions", "deletions")
    side = F.when(F.col("deletions") % 5 == 0, "LEFT").otherwise("RIGHT")
    added = F.when(F.col("additions") > 0, F.sequence(F.lit(1), F.greatest(F.col("additions"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return p.select("id", F.coalesce(R.replacement(F.col("patch"), side, F.lit(2), F.lit(2) + F.col("deletions") % 7, added), F.lit("ok")).alias("outcome"))


def k10_current_heads(spark, d):
    j = load(spark, d, "review_jobs", "id", "repository_id", "pull_number", "head_sha", "created_at").distinct()
    return R.current_heads(j).select("id")


def o4_signals(spark, d):
    """The signals of each job: those on its files, by path and rule, at most 40 lines, with a head."""
    f = findings(spark, d)
    ours = f.select("repository_id", "job", "path").distinct()
    signals = f.filter("severity >= 2").select("repository_id", "path", F.col("category").alias("rule"), F.col("first").alias("line")).distinct()
    hit = S.top(ours.join(signals, ["repository_id", "path"]), ["job"], [F.col("path"), F.col("line"), F.col("rule")], 40)
    lines = hit.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s:%d %s", "path", "line", "rule").alias("t")))).alias("l"))
    return lines.select("job", F.md5(F.concat_ws("\n", F.lit("signals:"), F.col("l.t"))).alias("digest"), F.size("l").alias("lines"))


def h11_signal_order(spark, d):
    f = findings(spark, d)
    return R.ranked(f, ["job"], [F.col("path"), F.col("first"), F.col("category"), F.col("id")]).select("id", "position")


def e8_payload(spark, d):
    """The findings of each job as one JSON text, in order, at most 25."""
    f = S.top(findings(spark, d), ["job"], [F.col("id")], 25)
    return f.groupBy("job").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "severity"))), lambda x: F.struct((x["rank"] - 1).alias("index"), x["id"].alias("id"), x["severity"].alias("severity")))).alias("payload"))


def b15_merged_usage(spark, d):
    """The usage of each job merged with its attempt, later keys winning, as the JSON that is stored."""
    j = load(spark, d, "review_jobs", "id", "usage", "attempt").distinct()
    old = F.coalesce(F.from_json("usage", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != "output_tokens"), F.create_map(F.lit("output_tokens"), F.col("attempt").cast("string"))))
    get = lambda k: F.get_json_object(merged, f"$.{k}")
    return j.select("id", get("input_tokens").alias("input_tokens"), get("output_tokens").alias("output_tokens"))


def e10_anchors(spark, d):
    """Where a comment is anchored: a start line only if it has several."""
    f = findings(spark, d)
    return f.select("id", "path", F.col("last").alias("line"), F.when(F.col("first") < F.col("last"), F.col("first")).alias("start_line"))


def e4_prompts(spark, d):
    """The tagged blocks of each evaluation item's prompt."""
    e = load(spark, d, "eval_cases", "case_id", "title", "body", "new_code")
    tag = lambda t, c: F.concat(F.lit(f"<{t}>\n"), F.coalesce(c, F.lit("")), F.lit(f"\n</{t}>"))
    return e.select("case_id", F.md5(F.concat_ws("\n\n", tag("title", "title"), tag("body", "body"), tag("code", "new_code"))).alias("digest"))


def l9_outcomes(spark, d):
    """Whether the files of a job were all read, some or none."""
    f = findings(spark, d)
    return R.outcomes(f.select("job", (F.col("severity") > 1).alias("ok")), ["job"])


def g3_previous_ready(spark, d):
    """For each snapshot the last ready one of its repository with another commit."""
    s = load(spark, d, "repository_snapshots", "id", "repository_id", "commit_sha", "status", "finished_at").distinct()
    ready = s.filter("status = 'ready' and finished_at is not null").groupBy("repository_id", "commit_sha").agg(F.max(F.struct("finished_at", "id")).alias("m"))
    # the two newest commits of a repository are enough: one of them differs
    two = S.top(ready, ["repository_id"], [F.desc("m.finished_at"), F.desc("m.id")], 2).select("repository_id", F.col("commit_sha").alias("other"), "m", "rank")
    hit = s.join(two, "repository_id").filter(F.col("other") != F.col("commit_sha"))
    return hit.groupBy("id").agg(F.min(F.struct("rank", "m.id")).alias("b")).select("id", F.col("b.id").alias("previous"))


def c26_safe_paths(spark, d):
    """Paths as reports write them that stay within the tree."""
    p = changed(spark, d, "id", "path")
    k = F.ascii(F.substring("id", 1, 1)) % 4
    told = F.when(k == 0, F.concat(F.lit("/"), F.col("path"))).when(k == 1, F.concat(F.lit("a/../"), F.col("path"))).when(k == 2, F.concat(F.lit("./"), F.col("path"))).otherwise(F.col("path"))
    return p.select("id", (~told.rlike(r"^/|^[A-Za-z]:|\\") & ~told.rlike(r"(^|/)\.\.(/|$)")).alias("safe"))


def c28_finding_rules(spark, d):
    """The first rule of its form that each finding breaks."""
    rules = {"confidence": F.col("confidence").between(0, 0.95), "severity": F.col("severity").isin(0, 1, 2, 3), "path": F.length("path").between(1, 400), "order": F.col("last") >= F.col("first"),
             "span": F.col("last") - F.col("first") <= 30}
    return findings(spark, d).select("id", F.coalesce(K.reasons(rules), F.lit("valid")).alias("reason"))


def j22_budgets(spark, d):
    """The room left for context beside the diff of each job, in a window of 8000 tokens."""
    p = changed(spark, d, "id", "review_job_id", "patch")
    s = p.groupBy("review_job_id").agg(F.sum(F.coalesce(T.estimate_tokens(F.col("patch")), F.lit(0))).alias("diff"))
    limit = 8000
    return s.select("review_job_id", F.greatest(F.lit(min(2000, limit // 4)), F.lit(limit) - F.col("diff") - 2500).cast("bigint").alias("budget"))


def h9_callers(spark, d):
    """Callers of each name, those first whose file imports something, then by path and line."""
    c = chunks(spark, d, "id", "repository_id", "path", "start_line", "symbol_type", "is_test", "called_names", "imports")
    calls = c.filter(~F.col("is_test") & F.col("symbol_type").isin("function", "method")).select("repository_id", "id", "path", "start_line", (F.size("imports") == 0).alias("unimported"), F.explode(F.array_distinct("called_names")).alias("name"))
    return S.top(calls, ["repository_id", "name"], [F.col("unimported"), F.col("path"), F.col("start_line"), F.col("id")], 3).select("repository_id", "name", "rank", "id")


def c4_tests_by_stem(spark, d):
    """Test functions whose file is named after what another file of the repository is about, the last word of its name."""
    c = chunks(spark, d, "id", "repository_id", "path", "symbol_type", "is_test")
    stem = lambda p: F.regexp_extract(p, r"([a-z]+)\d*\.[^./]+$", 1)
    p = c.filter("not is_test").select("repository_id", stem("path").alias("stem")).distinct()
    t = c.filter(F.col("is_test") & F.col("symbol_type").isin("function", "method")).select("repository_id", "id", stem("path").alias("stem"))
    return t.join(p, ["repository_id", "stem"], "left_semi").select("id")


def a2_live_repositories(spark, d):
    return load(spark, d, "repositories", "id", "github_repo_id", "owner", "name", "deleted_at").filter("deleted_at is null").select("id", "github_repo_id", F.concat_ws("/", "owner", "name").alias("full_name"))


def a3_ready_snapshots(spark, d):
    return load(spark, d, "repository_snapshots", "id", "repository_id", "status").distinct().filter("status = 'ready'").select("id", "repository_id")


def a12_open_jobs(spark, d):
    return load(spark, d, "review_jobs", "id", "status", "created_at").distinct().filter(F.col("status").isin("queued", "running", "publishing")).select("id", "created_at")


def a20_findings(spark, d):
    """Findings of a status, in order, as a page would show them."""
    f = findings(spark, d).filter("category = 'added'")
    return R.ranked(f, ["job"], [F.col("first"), F.col("id")]).select("job", "position", "id")


def f12_measures(spark, d):
    """All measures over cases: repositories are the cases, the path rule is what is expected, the stored flag what is found."""
    from cairnlake.functions import classify as C

    p = changed(spark, d, "id", "repository_id", "path", "is_generated", "skip_reason", "additions", "deletions")
    e, a = C.is_generated(F.col("path")), F.coalesce("is_generated", F.lit(False))
    case = p.groupBy("repository_id").agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count_if(a).alias("accepted"), F.count_if(e).alias("expected"),
                                          F.count_if(F.col("skip_reason").isNotNull()).alias("rejected"), F.count("*").alias("raw"), F.sum("additions").alias("latency"))
    r = lambda n, m: F.round(F.coalesce(F.try_divide(n, m), F.lit(0.0)), 6)
    s = lambda c: F.sum(c)
    prec, rec = F.coalesce(F.try_divide(s("tp"), s(F.col("tp") + F.col("fp"))), F.lit(0.0)), F.coalesce(F.try_divide(s("tp"), s(F.col("tp") + F.col("fn"))), F.lit(0.0))
    clean = F.col("expected") == 0
    return case.agg(F.count("*").alias("cases"), F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), r(2 * prec * rec, prec + rec).alias("f1"), r(s("fp"), F.count("*")).alias("fp_per_case"),
                    F.coalesce(s(F.when(clean, F.col("accepted"))), F.lit(0)).alias("fp_on_clean"), r(F.count_if(clean & (F.col("accepted") > 0)), F.count_if(clean)).alias("clean_with_any"), r(s("rejected"), s("raw")).alias("reject_rate"),
                    r(s("latency"), F.count("*")).alias("mean_latency"))


QUERIES = {f.__name__: f for f in (
    h7_finding_rank, h8_publish_order, f8_overall_risk, f7_usage_ledger, d21_verdicts, d19_references, d20_reference_labels, d22_fresh_comments, d23_comment_ids, b2_new_deliveries, b4_inserted_chunks, b5_cache_inserts,
    d14_calls_within_changes, d15_sibling_calls, d16_alias_calls, f4_merged_spans, i3_shared_names, j12_code_tokens, j13_normalized_paths, j29_evidence, j30_replacements, k10_current_heads, o4_signals, h11_signal_order,
    e8_payload, b15_merged_usage, e10_anchors, e4_prompts, l9_outcomes, g3_previous_ready, c26_safe_paths, c28_finding_rules, j22_budgets, h9_callers, c4_tests_by_stem, a2_live_repositories, a3_ready_snapshots, a12_open_jobs, a20_findings,
    f12_measures)}

_FIND = """f AS (SELECT DISTINCT id, review_job_id AS job, repository_id, pull_number, path, status AS category, ascii(substr(id, 1, 1)) % 4 AS severity, ((additions * 7 + deletions * 13) % 100) / 100.0::DOUBLE AS confidence,
  additions + 1 AS first, additions + 1 + deletions % 40 AS last FROM changed_files)"""
_KEY = "repository_id, blob_sha, chunker_version"
_STRIP = "regexp_replace({0}, '" + R.GUTTER.replace("\\s", "[ \\t\\n\\f\\r]") + "', '')"
_COLL = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_TOKS = "list_filter(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda t: NOT list_contains(['" + "', '".join(R.STRING_PREFIXES) + "'], lower(t)))"
_KNOWN = "p AS (SELECT DISTINCT id, review_job_id, path FROM changed_files), known AS (SELECT review_job_id, list(DISTINCT path) AS known FROM p GROUP BY 1)"

SQL = {
    "h7_finding_rank": f"WITH {_FIND} SELECT id, row_number() OVER (PARTITION BY job ORDER BY severity * 10 + confidence DESC, id)::INT AS position FROM f",
    "h8_publish_order": f"WITH {_FIND} SELECT id, row_number() OVER (PARTITION BY job ORDER BY severity DESC, confidence DESC, path, first, id)::INT AS position FROM f",
    "f8_overall_risk": f"WITH {_FIND} SELECT job, ['low', 'medium', 'high', 'critical'][max(severity) + 1] AS risk FROM f GROUP BY job",
    "f7_usage_ledger": """WITH j AS (SELECT DISTINCT id, repository_id, pull_number, created_at, usage FROM review_jobs),
        n AS (SELECT *, row_number() OVER (PARTITION BY repository_id, pull_number ORDER BY created_at DESC, id DESC) AS k FROM j)
        SELECT repository_id, pull_number, sum(coalesce(try_cast(usage->>'$.input_tokens' AS BIGINT), 0))::BIGINT AS input_tokens, sum(coalesce(try_cast(usage->>'$.output_tokens' AS BIGINT), 0))::BIGINT AS output_tokens, count(*) AS calls,
          string_agg(id, ',' ORDER BY created_at, id) FILTER (WHERE k <= 3) AS last_ids FROM n GROUP BY ALL""",
    "d21_verdicts": f"""WITH {_FIND}, c AS (SELECT id, job, row_number() OVER (PARTITION BY job ORDER BY id)::INT - 1 AS n FROM f), v AS (SELECT job, last % 9 AS n, min(severity > 0) AS keep FROM f GROUP BY ALL)
        SELECT c.id, c.job, c.n FROM c LEFT JOIN v ON c.job = v.job AND c.n = v.n WHERE coalesce(keep, true)""",
    "d19_references": f"""WITH {_FIND}, r AS (SELECT *, list_distinct(['ctx-' || (first % 5), 'ctx-' || (last % 7)]) AS refs FROM f), k AS (SELECT job, list('ctx-' || severity) AS known FROM f GROUP BY job),
        u AS (SELECT id, confidence, list_sort(list_filter(refs, lambda x: NOT list_contains(known, x))) AS un FROM r JOIN k USING (job))
        SELECT id, array_to_string(un, ',') AS unknown, round(confidence * CASE WHEN len(un) > 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 4) AS confidence FROM u""",
    "d20_reference_labels": f"""WITH c AS (SELECT DISTINCT id, {_KEY}, path, symbol_type, qualified_name, parent_symbol, start_line, end_line FROM code_chunks)
        SELECT m.id, string_agg(DISTINCT k.path || ':' || k.start_line || '-' || k.end_line, ',' ORDER BY k.path || ':' || k.start_line || '-' || k.end_line) AS labels FROM c m JOIN c k ON m.repository_id = k.repository_id AND m.blob_sha = k.blob_sha
          AND m.chunker_version = k.chunker_version AND m.parent_symbol = k.qualified_name WHERE m.symbol_type = 'method' AND k.symbol_type = 'class' GROUP BY 1""",
    "d22_fresh_comments": f"WITH {_FIND}, g AS (SELECT *, md5(concat_ws('|', repository_id, pull_number, path, category)) AS fingerprint FROM f) SELECT id, fingerprint FROM g WHERE severity < 3 AND fingerprint NOT IN (SELECT fingerprint FROM g WHERE severity = 3)",
    "d23_comment_ids": f"""WITH {_FIND}, g AS (SELECT *, md5(concat_ws('|', repository_id, pull_number, path, category)) AS fingerprint FROM f), k AS (SELECT fingerprint, job, min(id) AS comment_id FROM g WHERE severity = 3 GROUP BY ALL)
        SELECT id, comment_id FROM g LEFT JOIN k USING (fingerprint, job)""",
    "b2_new_deliveries": "SELECT DISTINCT delivery_id FROM review_jobs WHERE trigger <> 'webhook' AND delivery_id IS NOT NULL AND delivery_id NOT IN (SELECT delivery_id FROM review_jobs WHERE trigger = 'webhook' AND delivery_id IS NOT NULL)",
    "b4_inserted_chunks": """WITH k AS (SELECT DISTINCT chunker_version, repository_id, blob_sha, start_line, symbol_type, qualified_name FROM code_chunks)
        SELECT repository_id, count(*) AS inserted FROM k a WHERE chunker_version = '1' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.chunker_version = '0' AND a.repository_id = b.repository_id AND a.blob_sha = b.blob_sha
          AND a.start_line IS NOT DISTINCT FROM b.start_line AND a.symbol_type IS NOT DISTINCT FROM b.symbol_type AND a.qualified_name IS NOT DISTINCT FROM b.qualified_name) GROUP BY 1""",
    "b5_cache_inserts": """SELECT DISTINCT content_hash, embedding_model FROM code_chunks WHERE embedding_model IS NOT NULL
        AND (content_hash, embedding_model) NOT IN (SELECT (content_hash, embedding_model) FROM embedding_cache WHERE content_hash NOT LIKE 'a%')""",
    "d14_calls_within_changes": """WITH c AS (SELECT DISTINCT id, repository_id, symbol, symbol_type, qualified_name, called_names FROM code_chunks), b AS (SELECT DISTINCT repository_id, id, unnest(list_append(called_names, symbol)) AS name FROM c)
        SELECT b.id, c.id AS target FROM b JOIN c ON b.repository_id = c.repository_id AND b.name = c.qualified_name WHERE c.symbol_type IN ('function', 'class') AND b.id <> c.id AND NOT contains(b.name, '.')""",
    "d15_sibling_calls": f"""WITH m AS (SELECT DISTINCT id, {_KEY}, symbol, parent_symbol FROM code_chunks WHERE symbol_type = 'method' AND parent_symbol IS NOT NULL)
        SELECT a.id, b.symbol AS name, b.id AS target FROM m a JOIN m b ON a.repository_id = b.repository_id AND a.blob_sha = b.blob_sha AND a.chunker_version = b.chunker_version AND a.parent_symbol = b.parent_symbol WHERE a.id <> b.id""",
    "d16_alias_calls": """WITH c AS (SELECT DISTINCT id, repository_id, path, symbol, symbol_type, called_names, regexp_extract(path, '([^/]+)\\.py$', 1) AS stem FROM code_chunks WHERE language = 'python'),
        k AS (SELECT repository_id, id, unnest(list_append(called_names, symbol)) AS name FROM c)
        SELECT DISTINCT k.id, d.stem || '.' || d.symbol AS call, d.id AS target FROM k JOIN c d ON k.repository_id = d.repository_id AND k.name = d.symbol WHERE d.symbol_type IN ('function', 'class')""",
    "f4_merged_spans": """WITH c AS (SELECT DISTINCT id, repository_id, blob_sha, start_line, end_line, 2 - chunker_version::INT AS tier, token_count::DOUBLE AS score, symbol_type || ':' || chunker_version AS reason FROM code_chunks),
        r AS (SELECT repository_id, blob_sha, start_line, end_line, reason, min(id) AS pos FROM c GROUP BY ALL), w AS (SELECT repository_id, blob_sha, start_line, end_line, string_agg(reason, ',' ORDER BY pos) AS reasons FROM r GROUP BY ALL),
        b AS (SELECT repository_id, blob_sha, start_line, end_line, min(tier) AS tier, max(score) AS score, count(*) AS merged FROM c GROUP BY ALL)
        SELECT b.*, reasons FROM b JOIN w ON b.repository_id = w.repository_id AND b.blob_sha = w.blob_sha AND b.start_line IS NOT DISTINCT FROM w.start_line AND b.end_line IS NOT DISTINCT FROM w.end_line""",
    "i3_shared_names": """WITH c AS (SELECT DISTINCT id, repository_id, symbol, symbol_type, called_names, is_test FROM code_chunks),
        d AS (SELECT repository_id, list(DISTINCT symbol) AS defined FROM c WHERE NOT is_test AND symbol_type IN ('function', 'method', 'class') AND symbol IS NOT NULL GROUP BY 1)
        SELECT id, coalesce(array_to_string(list_filter(list_append(called_names, symbol), lambda x, i: list_contains(coalesce(defined, []), x) AND list_position(list_append(called_names, symbol), x) = i), ','), '') AS names FROM c LEFT JOIN d USING (repository_id) WHERE is_test""",
    "j12_code_tokens": f"""WITH p AS (SELECT DISTINCT id, ' 12 + | ' || regexp_extract(patch, '\\n([^\\n\\r]*)', 1) AS t FROM changed_files WHERE patch IS NOT NULL)
        SELECT id, array_to_string({_TOKS.format(_COLL.format(_STRIP.format('t')))}, ' ') AS tokens FROM p""",
    "j13_normalized_paths": f"""WITH {_KNOWN}, t AS (SELECT id, known, CASE ascii(substr(id, 2, 1)) % 5 WHEN 0 THEN ' `./' || path || '` ' WHEN 1 THEN chr(39) || 'a/' || path || chr(39) WHEN 2 THEN 'b/' || path WHEN 3 THEN 'x/' || path ELSE path END AS t
          FROM p JOIN known USING (review_job_id)), b AS (SELECT id, known, trim(trim(t), chr(96) || chr(39) || chr(34)) AS b FROM t)
        SELECT id, list_filter([b, regexp_replace(b, '^\\./', ''), regexp_replace(b, '^a/', ''), regexp_replace(b, '^b/', '')], lambda x: list_contains(known, x))[1] AS path FROM b""",
    "j29_evidence": f"""WITH c AS (SELECT DISTINCT id, signature, content FROM code_chunks WHERE signature IS NOT NULL AND content IS NOT NULL),
        q AS (SELECT id, {_COLL.format('content')} AS body, CASE ascii(substr(id, 1, 1)) % 4 WHEN 0 THEN signature WHEN 1 THEN '9 + | see ' || regexp_replace(signature, '[(,):]', ' ; ', 'g') WHEN 2 THEN substr(signature, 1, 5) ELSE signature || ' ?? other things here' END AS t FROM c),
        l AS (SELECT id, body, list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n'), lambda x: {_COLL.format(_STRIP.format('x'))}), lambda x: x <> '') AS ls FROM q),
        j AS (SELECT *, array_to_string(ls, ' ') AS joined FROM l),
        k AS (SELECT *, {_TOKS.format('joined')} AS tk, ' ' || array_to_string({_TOKS.format('body')}, ' ') AS tt FROM j),
        r AS (SELECT *, floor(len(tk) * 0.2 + 1e-9)::INT AS most FROM k),
        e AS (SELECT *, list_filter(flatten(list_transform(range(0, most + 1), lambda a: list_transform(range(0, most - a + 1), lambda b: tk[a + 1:len(tk) - b]))), lambda x: len(x) >= 3 AND length(array_to_string(x, '')) >= 12) AS runs FROM r)
        SELECT id, CASE WHEN coalesce(length(joined), 0) < 6 THEN 'short' WHEN contains(body, joined) THEN 'verbatim' WHEN len(ls) > 1 AND len(list_filter(ls, lambda x: contains(body, x))) >= 0.9 * len(ls) THEN 'lines'
          WHEN len(tk) >= 3 AND length(array_to_string(tk, '')) >= 12 AND len(list_filter(runs, lambda x: contains(tt, ' ' || array_to_string(x, ' ')))) > 0 THEN 'tokens' ELSE 'none' END AS match FROM e""",
    "j30_replacements": """WITH p AS (SELECT DISTINCT id, patch, additions, deletions FROM changed_files)
        SELECT id, CASE WHEN deletions % 5 = 0 THEN 'side' WHEN trim(coalesce(patch, ''), ' ') = '' THEN 'blank' WHEN contains(patch, '```') THEN 'fence' WHEN len(string_split(regexp_replace(patch, '\\n$', ''), chr(10))) > 40 THEN 'long'
          WHEN 2 + deletions % 7 > additions THEN 'not_added' ELSE 'ok' END AS outcome FROM p""",
    "k10_current_heads": """WITH j AS (SELECT DISTINCT id, repository_id, pull_number, head_sha, created_at FROM review_jobs), l AS (SELECT repository_id, pull_number, arg_max(head_sha, (created_at, id)) AS head_sha FROM j GROUP BY ALL)
        SELECT id FROM j JOIN l USING (repository_id, pull_number, head_sha)""",
    "o4_signals": f"""WITH {_FIND}, o AS (SELECT DISTINCT repository_id, job, path FROM f), s AS (SELECT DISTINCT repository_id, path, category, first FROM f WHERE severity >= 2),
        n AS (SELECT job, path || ':' || first || ' ' || category AS t, row_number() OVER (PARTITION BY job ORDER BY path, first, category) AS k FROM o JOIN s USING (repository_id, path))
        SELECT job, md5('signals:' || chr(10) || string_agg(t, chr(10) ORDER BY k)) AS digest, count(*)::INT AS lines FROM n WHERE k <= 40 GROUP BY job""",
    "h11_signal_order": f"WITH {_FIND} SELECT id, row_number() OVER (PARTITION BY job ORDER BY path, first, category, id)::INT AS position FROM f",
    "e8_payload": f"""WITH {_FIND}, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY id) - 1 AS k FROM f)
        SELECT job, '[' || string_agg('{{"index":' || k || ',"id":"' || id || '","severity":' || severity || '}}', ',' ORDER BY k) || ']' AS payload FROM n WHERE k < 25 GROUP BY job""",
    "b15_merged_usage": "SELECT DISTINCT id, usage->>'$.input_tokens' AS input_tokens, attempt::VARCHAR AS output_tokens FROM review_jobs",
    "e10_anchors": f"WITH {_FIND} SELECT id, path, last AS line, CASE WHEN first < last THEN first END AS start_line FROM f",
    "e4_prompts": """SELECT case_id, md5('<title>' || chr(10) || coalesce(title, '') || chr(10) || '</title>' || chr(10) || chr(10) || '<body>' || chr(10) || coalesce(body, '') || chr(10) || '</body>' || chr(10) || chr(10)
        || '<code>' || chr(10) || coalesce(new_code, '') || chr(10) || '</code>') AS digest FROM eval_cases""",
    "l9_outcomes": f"""WITH {_FIND} SELECT job, count(*) AS batches, CASE WHEN count(*) FILTER (WHERE severity > 1) = count(*) THEN 'complete' WHEN count(*) FILTER (WHERE severity > 1) > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM f GROUP BY job""",
    "g3_previous_ready": """WITH s AS (SELECT DISTINCT id, repository_id, commit_sha, status, finished_at FROM repository_snapshots)
        SELECT id, previous FROM (SELECT a.id, b.id AS previous, row_number() OVER (PARTITION BY a.id ORDER BY b.finished_at DESC, b.id DESC) AS k FROM s a JOIN s b ON a.repository_id = b.repository_id AND a.commit_sha <> b.commit_sha
          WHERE b.status = 'ready' AND b.finished_at IS NOT NULL) WHERE k = 1""",
    "c26_safe_paths": "SELECT DISTINCT id, ascii(substr(id, 1, 1)) % 4 NOT IN (0, 1) AS safe FROM changed_files",
    "c28_finding_rules": f"WITH {_FIND} SELECT id, CASE WHEN confidence > 0.95 THEN 'confidence' WHEN length(path) NOT BETWEEN 1 AND 400 THEN 'path' WHEN last < first THEN 'order' WHEN last - first > 30 THEN 'span' ELSE 'valid' END AS reason FROM f",
    "j22_budgets": """WITH p AS (SELECT DISTINCT id, review_job_id, patch FROM changed_files)
        SELECT review_job_id, greatest(2000, 8000 - sum(CASE WHEN patch IS NULL OR patch = '' THEN 0 ELSE greatest(1, length(patch) // 4) END) - 2500)::BIGINT AS budget FROM p GROUP BY 1""",
    "h9_callers": """WITH c AS (SELECT DISTINCT id, repository_id, path, start_line, called_names, imports FROM code_chunks WHERE NOT is_test AND symbol_type IN ('function', 'method')),
        k AS (SELECT DISTINCT repository_id, id, path, start_line, len(imports) = 0 AS un, unnest(called_names) AS name FROM c)
        SELECT repository_id, name, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, name ORDER BY un, path, start_line, id)::INT AS rank FROM k) WHERE rank <= 3""",
    "c4_tests_by_stem": """SELECT DISTINCT c.id FROM code_chunks c JOIN code_chunks p ON c.repository_id = p.repository_id AND NOT p.is_test
          AND regexp_extract(c.path, '([a-z]+)\\d*\\.[^./]+$', 1) = regexp_extract(p.path, '([a-z]+)\\d*\\.[^./]+$', 1) AND regexp_extract(p.path, '([a-z]+)\\d*\\.[^./]+$', 1) IS NOT NULL WHERE c.is_test AND c.symbol_type IN ('function', 'method')""",
    "a2_live_repositories": "SELECT id, github_repo_id, owner || '/' || name AS full_name FROM repositories WHERE deleted_at IS NULL",
    "a3_ready_snapshots": "SELECT DISTINCT id, repository_id FROM repository_snapshots WHERE status = 'ready'",
    "a12_open_jobs": "SELECT DISTINCT id, created_at FROM review_jobs WHERE status IN ('queued', 'running', 'publishing')",
    "f12_measures": f"""WITH p AS (SELECT DISTINCT id, repository_id, path, {_GEN} AS e, coalesce(is_generated, false) AS a, skip_reason, additions FROM changed_files),
        c AS (SELECT repository_id, count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND a) AS fp, count(*) FILTER (WHERE e AND NOT a) AS fn, count(*) FILTER (WHERE a) AS acc, count(*) FILTER (WHERE e) AS ex,
          count(*) FILTER (WHERE skip_reason IS NOT NULL) AS rej, count(*) AS n, sum(additions) AS lat FROM p GROUP BY 1),
        t AS (SELECT count(*) AS cases, coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0.0)::DOUBLE AS pr, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0.0)::DOUBLE AS re, sum(fp) AS fp, coalesce(sum(acc) FILTER (WHERE ex = 0), 0)::BIGINT AS oc,
          count(*) FILTER (WHERE ex = 0 AND acc > 0) AS cw, count(*) FILTER (WHERE ex = 0) AS cl, sum(rej) AS rej, sum(n) AS n, sum(lat) AS lat FROM c)
        SELECT cases, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1, round(coalesce(fp / nullif(cases, 0), 0.0), 6)::DOUBLE AS fp_per_case, oc AS fp_on_clean,
          round(coalesce(cw / nullif(cl, 0), 0.0), 6)::DOUBLE AS clean_with_any, round(coalesce(rej / nullif(n, 0), 0.0), 6)::DOUBLE AS reject_rate, round(coalesce(lat / nullif(cases, 0), 0.0), 6)::DOUBLE AS mean_latency FROM t""",
    "a20_findings": f"WITH {_FIND} SELECT job, row_number() OVER (PARTITION BY job ORDER BY first, id)::INT AS position, id FROM f WHERE category = 'added'",
}
