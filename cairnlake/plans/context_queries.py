"""Queries: context bundles, checks and joins around chunks and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.operators import checks as K, context as N, diff as D, hybrid
from cairnlake.operators.search import top
from cairnlake.plans.fold_queries import _P, _lines
from cairnlake.plans.hybrid_queries import _H, queries_of
from cairnlake.plans.index_queries import _files, _snaps
from cairnlake.functions import fixed_values as V
from cairnlake.plans.text_queries import _list, changed, chunks
from cairnlake.session import durable
from cairnlake.sources.tables import load


_COLUMNS = (*N.FILE, "language", "parent_symbol", "bases", *(c for c in hybrid.COLUMNS if c != "repository_id"))


def _chunks(spark, d):
    return chunks(spark, d, *_COLUMNS)


def _stored(spark, d):
    """(chunks, changes): all chunks, those of a repository in few files, and the queries of hybrid search taken as changes."""
    rows = load(spark, d, "code_chunks", *_COLUMNS).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8)))
    c = durable(rows.repartition("repository_id", "part").distinct().drop("part"), "chunks")
    return c, durable(queries_of(c), "queries")


def n_context(spark, d):
    """The context of the queries of hybrid search taken as changes, under 1200 tokens, against all chunks."""
    c, changes = _stored(spark, d)
    return N.bundles(c, changes, 1200)


def n_tiers(spark, d):
    """Candidates of those changes by tier and reason."""
    c, changes = _stored(spark, d)
    return N.merged(N.candidates(c, changes)).groupBy("tier", "reasons").agg(F.count("*").alias("items"), F.countDistinct("bundle").alias("bundles"))


def _methods(c):
    return c.filter("symbol_type = 'method'").withColumnRenamed("id", "bundle").withColumn("own", F.col("symbol")).withColumn("owns", F.array("symbol"))


def n1_own_files(spark, d):
    c = _chunks(spark, d)
    return N.own_file(_methods(c), c).select("bundle", "item", "reason")


def n4_config(spark, d):
    """Configuration of the repository that shares most of a method's names."""
    c = _chunks(spark, d)
    return N.lexical(_methods(c), c.filter(F.col("language").isin(*N.CONFIG_LANGUAGES)), 2).select("bundle", "rank", "id", F.col("s").alias("shared"))


def n6_guides(spark, d):
    """The two documents of the repository that share most words with a method."""
    c = durable(chunks(spark, d, *N.FILE, "id", "path", "start_line", "language", "symbol", "symbol_type", "qualified_name", "parent_symbol", "called_names", "token_count", "content")
                .filter("symbol_type = 'method' or language = 'markdown'"), "chunks")
    return N.guides(_methods(c), c, ["%.md"]).select("bundle", "item")


def c9_excluded(spark, d):
    """Manifest rows of ready snapshots but for the paths that pull requests of the repository changed."""
    m = _files(spark, d).join(_snaps(spark, d, "status").filter("status = 'ready'").withColumnRenamed("id", "snapshot_id"), "snapshot_id")
    touched = load(spark, d, "changed_files", "repository_id", "path").distinct()
    return m.join(touched, ["repository_id", "path"], "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("paths"))


def b12_purged(spark, d):
    """What stays of each repository's chunks and snapshots once soft-deleted repositories are purged."""
    live = load(spark, d, "repositories", "id", "deleted_at").filter("deleted_at is null").select(F.col("id").alias("repository_id"))
    c = chunks(spark, d, "id", "repository_id").join(live, "repository_id", "left_semi").groupBy("repository_id").agg(F.count("*").alias("chunks"))
    s = _snaps(spark, d).join(live, "repository_id", "left_semi").groupBy("repository_id").agg(F.count("*").alias("snapshots"))
    return live.join(c, "repository_id", "left").join(s, "repository_id", "left").select("repository_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


def g5_snapped(spark, d):
    """Ranges three lines wider than the added ones, moved onto lines of the patch."""
    lines = _lines(spark, d).filter("hunk > 0")
    wide = D.ranges(lines.filter("kind = 'add'"), ["id"], "new_no").select("id", F.col("range_start").alias("item"), (F.col("range_start") - 3).alias("first"), (F.col("range_end") + 3).alias("last"))
    return K.snap(wide, lines.filter("new_no is not null").select("id", F.col("new_no").alias("n")), ["id"])


def c28_usage_rules(spark, d):
    """Usage records of the jobs against the rules of their form."""
    j = load(spark, d, "review_jobs", "id", "usage").distinct()
    num = lambda k: F.expr(f"try_cast(get_json_object(usage, '$.{k}') as double)")
    rules = {"no_record": F.col("usage").isNotNull() & (F.col("usage") != ""), "no_input": num("input_tokens").isNotNull(), "no_output": num("output_tokens").isNotNull(),
             "negative": (num("input_tokens") >= 0) & (num("output_tokens") >= 0), "too_large": num("input_tokens") <= 1e9}
    return j.groupBy(F.coalesce(K.reasons(rules), F.lit("valid")).alias("outcome")).agg(F.count("*").alias("jobs"))


def c25_signatures(spark, d):
    """Delivery ids, half of them with the right signature, the others with that of another secret."""
    j = load(spark, d, "review_jobs", "delivery_id").filter("delivery_id is not null").distinct()
    told = F.when(F.ascii("delivery_id") % 2 == 0, K.signature(F.col("delivery_id"), "secret")).otherwise(K.signature(F.col("delivery_id"), "other"))
    return j.select("delivery_id", K.signed(F.col("delivery_id"), "secret", told).alias("accepted"))


def e7_scope(spark, d):
    """The scope of each job as JSON: files, changed lines, added and removed."""
    p = changed(spark, d, "id", "review_job_id", "additions", "deletions", "status")
    s = p.groupBy("review_job_id").agg(F.count("*").alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"), F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "removed").alias("removed"))
    return s.select("review_job_id", F.to_json(F.struct("files", "lines", "added", "removed")).alias("scope"))


def a16_anchors(spark, d):
    """First line of each item's code that holds an assertion."""
    e = load(spark, d, "eval_cases", "case_id", "new_code").select("case_id", F.posexplode(F.split("new_code", "\n")).alias("n", "t"))
    return e.filter(F.col("t").contains("assert")).groupBy("case_id").agg((F.min("n") + 1).alias("line"))


def h10_guides(spark, d):
    """The two document chunks of each repository that share most words with its symbols' names."""
    c = chunks(spark, d, "id", "repository_id", "language", "path", "start_line", "symbol", "content")
    names = c.filter("symbol is not null and language <> 'markdown'").select("repository_id", F.explode(T.query_terms(F.col("symbol"))).alias("word")).distinct()
    docs = c.filter("language = 'markdown'").select("repository_id", "id", "path", "start_line", F.explode(F.array_distinct(T.index_terms(F.col("content")))).alias("word"))
    n = docs.join(names, ["repository_id", "word"], "left_semi").groupBy("repository_id", "id", "path", "start_line").agg(F.count("*").alias("shared"))
    return top(n, ["repository_id"], [F.desc("shared"), F.col("path"), F.col("start_line"), F.col("id")], 2).select("repository_id", "rank", "id", "shared")


def f13_rollup(spark, d):
    """Files and lines by language and status, with all subtotals."""
    p = changed(spark, d, "id", "language", "status", "additions", "deletions").withColumn("language", F.coalesce("language", F.lit("none")))
    return p.rollup("language", "status").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")).select(
        F.coalesce("language", F.lit("(all)")).alias("language"), F.coalesce("status", F.lit("(all)")).alias("status"), "files", "additions", "deletions")


def b4_identities(spark, d):
    """Chunks that an insert keyed by identity would refuse, nulls being equal."""
    key = ["repository_id", "blob_sha", "chunker_version", "start_line", "symbol_type", "qualified_name"]
    c = chunks(spark, d, "id", *key)
    return c.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("refused"))


QUERIES = {f.__name__: f for f in (n_context, n_tiers, n1_own_files, n4_config, n6_guides, c9_excluded, b12_purged, g5_snapped, c28_usage_rules, c25_signatures, e7_scope, a16_anchors, h10_guides, f13_rollup, b4_identities)}

_M = "m AS (SELECT DISTINCT snapshot_id, path, lower(blob_sha) AS blob_sha FROM snapshot_files)"
_RUNS = """v AS (SELECT id, min(n) AS s, max(n) AS e FROM (SELECT id, n, n - row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM (SELECT DISTINCT id, new_no AS n FROM l WHERE kind <> 'del')) GROUP BY id, i),
  a AS (SELECT id, min(n) AS s, max(n) AS e FROM (SELECT id, n, n - row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM (SELECT DISTINCT id, new_no AS n FROM l WHERE kind = 'add')) GROUP BY id, i)"""

_CC = """c AS (SELECT DISTINCT id, repository_id, blob_sha, chunker_version, path, start_line, language, symbol, symbol_type, qualified_name, parent_symbol, called_names, token_count, content FROM code_chunks),
  k AS (SELECT *, list_append(called_names, symbol) AS names FROM c WHERE symbol_type = 'method')"""

_FILE_IS = "c.repository_id = q.repository_id AND c.blob_sha = q.blob_sha AND c.chunker_version = q.chunker_version"
_STEM = "regexp_extract({0}, '([^/]+?)\\.[^./]+$', 1)"


def _lexical_sql(name: str, where: str) -> str:
    return f"""{name}p AS (SELECT id, repository_id, path, start_line, term, count(*) AS tf FROM (SELECT id, repository_id, path, start_line, unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) AS term FROM c WHERE {where}) WHERE term <> '' GROUP BY ALL),
  {name} AS (SELECT bundle, id AS item FROM (SELECT bundle, x.id, row_number() OVER (PARTITION BY bundle ORDER BY sum(tf) DESC, path, start_line, x.id) AS k FROM {name}p x JOIN cw ON x.repository_id = cw.repository_id AND x.term = cw.term WHERE path <> own
    GROUP BY bundle, x.id, path, start_line) WHERE k <= 2)"""


_TIERS = f"""{_H},
  cl AS (SELECT id AS bundle, repository_id, path AS own, qualified_name, unnest(called_names) AS call FROM q),
  sib AS (SELECT DISTINCT q.id AS bundle, c.id AS item FROM q JOIN c ON {_FILE_IS} AND c.symbol_type = 'method' AND c.id <> q.id AND (list_contains(q.called_names, 'self.' || c.symbol) OR list_contains(q.called_names, 'cls.' || c.symbol))),
  spr AS (SELECT DISTINCT q.id AS bundle, c.id AS item FROM q JOIN c ON {_FILE_IS} AND c.symbol_type IN ('function', 'class') AND c.id <> q.id AND list_contains(q.called_names, c.qualified_name) AND NOT contains(c.qualified_name, '.') AND c.qualified_name IS DISTINCT FROM q.qualified_name),
  bs AS (SELECT id AS bundle, repository_id, path AS own, unnest(bases) AS name FROM q),
  bas AS (SELECT bundle, id AS item FROM (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY path, start_line, id) AS k FROM (SELECT DISTINCT bundle, c.id, c.path, c.start_line FROM bs JOIN c ON c.repository_id = bs.repository_id AND (c.symbol = name OR c.qualified_name = name)
    AND c.symbol_type IN ('function', 'method', 'class') AND c.path <> own)) WHERE k <= 2),
  us AS (SELECT bundle, id AS item FROM (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY path, start_line, id) AS k FROM (SELECT DISTINCT q.id AS bundle, c.id, c.path, c.start_line FROM q JOIN c ON c.repository_id = q.repository_id AND NOT c.is_test
    AND list_contains(c.called_names, q.symbol) AND c.path <> q.path)) WHERE k <= 3),
  ts AS (SELECT bundle, id AS item FROM (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY path, start_line, id) AS k FROM (SELECT DISTINCT q.id AS bundle, c.id, c.path, c.start_line FROM q JOIN c ON c.repository_id = q.repository_id AND c.is_test AND c.path <> q.path
    AND (list_contains(c.called_names, q.symbol) OR (NOT q.is_test AND c.symbol_type IN ('function', 'method') AND regexp_replace({_STEM.format('c.path')}, '^test_|_test$|\\.test$|\\.spec$', '', 'g') = {_STEM.format('q.path')})))) WHERE k <= 3),
  cw AS (SELECT bundle, repository_id, own, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, {V.QUERY_TERMS})) AS term FROM (SELECT id AS bundle, repository_id, path AS own, list_filter(flatten(list_transform(
    regexp_extract_all(array_to_string(list_append(called_names, symbol), ' '), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: string_split(lower(x), '_'))), lambda x: length(x) > 2 AND NOT list_contains({_list(V.STOP_WORDS)}, x)) AS l FROM q)),
  {_lexical_sql('cfg', "language IN ('yaml', 'toml', 'ini', 'json', 'dockerfile')")},
  {_lexical_sql('mig', "path ILIKE '%migrat%' OR path ILIKE '%alembic%' OR path ILIKE '%schema%'")},
  gd AS (SELECT id, repository_id, path, start_line, list_distinct(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]+')) AS gs FROM c WHERE language = 'markdown' AND token_count <= 400 AND ({' OR '.join(f"path ILIKE '{x}'" for x in V.GUIDE_PATHS)})),
  gw AS (SELECT id AS bundle, repository_id, path AS own, list_distinct(list_transform(regexp_extract_all(array_to_string(list_append(called_names, symbol), ' ') || ' ' || content, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))) AS ws FROM q),
  gu AS (SELECT bundle, id AS item FROM (SELECT bundle, id, row_number() OVER (PARTITION BY bundle ORDER BY len(list_intersect(ws, gs)) DESC, path, start_line, id) AS k FROM gw JOIN gd ON gw.repository_id = gd.repository_id WHERE path <> own) WHERE k <= 2),
  cand AS (SELECT id AS bundle, id AS item, 1 AS tier, 10.0::DOUBLE AS score, 'changed_symbol' AS reason FROM q
    UNION ALL SELECT q.id, c.id, 1, 9.0, 'enclosing_class' FROM q JOIN c ON {_FILE_IS} AND c.symbol_type = 'class' AND c.qualified_name = q.parent_symbol
    UNION ALL SELECT q.id, c.id, 1, 5.0, 'module_header' FROM q JOIN c ON {_FILE_IS} AND c.symbol_type = 'module' AND c.start_line = 1 AND c.token_count <= 300
    UNION ALL SELECT bundle, item, 2, 6.0, 'sibling_method' FROM sib UNION ALL SELECT bundle, item, 2, 7.0, 'same_pr_definition' FROM spr UNION ALL SELECT bundle, item, 2, 5.0, 'base_class' FROM bas UNION ALL SELECT bundle, item, 3, 5.0, 'calls' FROM us
    UNION ALL SELECT bundle, item, 4, 6.0, 'test_for_changed_symbol' FROM ts UNION ALL SELECT bundle, item, 4, 4.0, 'config_match' FROM cfg UNION ALL SELECT bundle, item, 4, 4.0, 'migration_or_schema' FROM mig
    UNION ALL SELECT query_id, b.id, 5, total, 'hybrid' FROM best b JOIN c ON c.id = b.id JOIN q ON q.id = b.query_id WHERE c.path <> q.path
    UNION ALL SELECT bundle, item, 6, 2.0, 'repository_guidelines' FROM gu),
  mg AS (SELECT bundle, item, min(tier) AS tier, max(score) AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM cand GROUP BY ALL)"""

SQL = {
    "n_context": f"""WITH RECURSIVE {_TIERS},
        i AS (SELECT mg.*, c.token_count AS size, c.path, c.start_line, row_number() OVER (PARTITION BY bundle ORDER BY tier, round(score, 9) DESC, item) AS n FROM mg JOIN c ON c.id = mg.item),
        cap(tier, c) AS (VALUES {', '.join(f'({t}, {int(1200 * x)})' for t, x in V.TIER_SHARES.items())}),
        a AS (SELECT bundle, item, tier, n, size, CASE WHEN tier = 1 THEN true ELSE size <= c AND size <= 1200 END AS take, CASE WHEN tier = 1 OR (size <= c AND size <= 1200) THEN size ELSE 0 END AS used,
            CASE WHEN tier <> 1 AND size <= c AND size <= 1200 THEN size ELSE 0 END AS spent FROM i JOIN cap USING (tier) WHERE n = 1
          UNION ALL SELECT i.bundle, i.item, i.tier, i.n, i.size, t.take, a.used + CASE WHEN t.take THEN i.size ELSE 0 END, t.sp + CASE WHEN t.take AND i.tier <> 1 THEN i.size ELSE 0 END FROM a JOIN i ON i.bundle = a.bundle AND i.n = a.n + 1 JOIN cap ON cap.tier = i.tier,
            LATERAL (SELECT CASE WHEN i.tier = a.tier THEN a.spent ELSE 0 END AS sp, i.tier = 1 OR (CASE WHEN i.tier = a.tier THEN a.spent ELSE 0 END + i.size <= cap.c AND a.used + i.size <= 1200) AS take) t),
        u AS (SELECT bundle, arg_max(used, n) AS used FROM a GROUP BY ALL),
        b AS (SELECT a.bundle, a.item, a.n, a.take OR u.used + a.size <= 1200 AS taken, u.used + CASE WHEN NOT a.take AND u.used + a.size <= 1200 THEN a.size ELSE 0 END AS used FROM a JOIN u USING (bundle) WHERE n = 1
          UNION ALL SELECT a.bundle, a.item, a.n, a.take OR b.used + a.size <= 1200, b.used + CASE WHEN NOT a.take AND b.used + a.size <= 1200 THEN a.size ELSE 0 END FROM b JOIN a ON a.bundle = b.bundle AND a.n = b.n + 1)
        SELECT i.bundle, i.item, i.tier, round(i.score, 6) AS score, i.reasons, b.taken, CASE WHEN b.taken THEN row_number() OVER (PARTITION BY i.bundle, b.taken ORDER BY i.tier, i.path, i.start_line, i.item)::INT END AS position
        FROM i JOIN b ON b.bundle = i.bundle AND b.item = i.item""",
    # no import of the data names a file of its repository by its own words, so no definition comes by import
    "n_tiers": f"WITH {_TIERS} SELECT tier, reasons, count(*) AS items, count(DISTINCT bundle) AS bundles FROM mg GROUP BY ALL",
    "c25_signatures": "SELECT DISTINCT delivery_id, ascii(delivery_id) % 2 = 0 AS accepted FROM review_jobs WHERE delivery_id IS NOT NULL",
    "n1_own_files": f"""WITH {_CC} SELECT id AS bundle, id AS item, 'changed_symbol' AS reason FROM k
        UNION ALL SELECT k.id, c.id, 'enclosing_class' FROM k JOIN c ON k.repository_id = c.repository_id AND k.blob_sha = c.blob_sha AND k.chunker_version = c.chunker_version AND k.parent_symbol = c.qualified_name WHERE c.symbol_type = 'class'
        UNION ALL SELECT k.id, c.id, 'module_header' FROM k JOIN c ON k.repository_id = c.repository_id AND k.blob_sha = c.blob_sha AND k.chunker_version = c.chunker_version WHERE c.symbol_type = 'module' AND c.start_line = 1 AND c.token_count <= 300""",
    "n4_config": f"""WITH {_CC}, w AS (SELECT id AS bundle, repository_id, path AS own, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, {V.QUERY_TERMS})) AS term FROM (SELECT *, list_filter(flatten(list_transform(
          regexp_extract_all(array_to_string(names, ' '), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: string_split(lower(x), '_'))), lambda x: length(x) > 2 AND NOT list_contains({_list(V.STOP_WORDS)}, x)) AS l FROM k)),
        p AS (SELECT id, repository_id, path, start_line, term, count(*) AS tf FROM (SELECT id, repository_id, path, start_line, unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) AS term FROM c WHERE language IN ('yaml', 'toml', 'ini', 'json', 'dockerfile')) WHERE term <> '' GROUP BY ALL),
        m AS (SELECT bundle, p.id, path, start_line, sum(tf)::BIGINT AS s FROM p JOIN w ON p.repository_id = w.repository_id AND p.term = w.term WHERE path <> own GROUP BY ALL)
        SELECT bundle, rank, id, s AS shared FROM (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY s DESC, path, start_line, id)::INT AS rank FROM m) WHERE rank <= 2""",
    "n6_guides": f"""WITH {_CC}, w AS (SELECT id AS bundle, repository_id, path AS own, list_distinct(list_transform(regexp_extract_all(array_to_string(names, ' ') || ' ' || content, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))) AS ws FROM k),
        g AS (SELECT id, repository_id, path, start_line, list_distinct(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]+')) AS gs FROM c WHERE language = 'markdown' AND token_count <= 400 AND path ILIKE '%.md')
        SELECT bundle, id AS item FROM (SELECT bundle, id, row_number() OVER (PARTITION BY bundle ORDER BY len(list_intersect(ws, gs)) DESC, path, start_line, id) AS r FROM w JOIN g ON w.repository_id = g.repository_id WHERE g.path <> own) WHERE r <= 2""",
    "c9_excluded": f"""WITH {_M} SELECT snapshot_id, count(*) AS paths FROM m JOIN repository_snapshots s ON s.id = m.snapshot_id AND s.status = 'ready'
        WHERE NOT EXISTS (SELECT 1 FROM changed_files f WHERE f.repository_id = s.repository_id AND f.path = m.path) GROUP BY 1""",
    "b12_purged": """SELECT id AS repository_id, (SELECT count(DISTINCT c.id) FROM code_chunks c WHERE c.repository_id = r.id) AS chunks, (SELECT count(*) FROM repository_snapshots s WHERE s.repository_id = r.id) AS snapshots
        FROM repositories r WHERE deleted_at IS NULL""",
    "g5_snapped": f"""WITH {_P}, {_RUNS}, h AS (SELECT a.id, a.s AS item, a.s - 3 AS first, a.e + 3 AS last, v.s, v.e, row_number() OVER (PARTITION BY a.id, a.s ORDER BY NOT (a.s - 3 BETWEEN v.s AND v.e), v.s) AS n
        FROM a JOIN v ON v.id = a.id AND (a.s - 3 BETWEEN v.s AND v.e OR a.e + 3 BETWEEN v.s AND v.e)) SELECT id, item::INT AS item, greatest(first, s)::INT AS low, least(last, e)::INT AS high FROM h WHERE n = 1""",
    "c28_usage_rules": """WITH j AS (SELECT usage, try_cast(json_extract_string(usage, '$.input_tokens') AS DOUBLE) AS i, try_cast(json_extract_string(usage, '$.output_tokens') AS DOUBLE) AS o FROM (SELECT DISTINCT id, usage FROM review_jobs))
        SELECT CASE WHEN usage IS NULL OR usage = '' THEN 'no_record' WHEN i IS NULL THEN 'no_input' WHEN o IS NULL THEN 'no_output' WHEN i < 0 OR o < 0 THEN 'negative' WHEN i > 1e9 THEN 'too_large' ELSE 'valid' END AS outcome, count(*) AS jobs FROM j GROUP BY 1""",
    "e7_scope": """SELECT review_job_id, '{"files":' || count(*) || ',"lines":' || sum(additions + deletions) || ',"added":' || count(*) FILTER (WHERE status = 'added') || ',"removed":' || count(*) FILTER (WHERE status = 'removed') || '}' AS scope
        FROM (SELECT DISTINCT id, review_job_id, additions, deletions, status FROM changed_files) GROUP BY 1""",
    "a16_anchors": "SELECT case_id, min(n)::INT AS line FROM (SELECT case_id, unnest(string_split(new_code, chr(10))) AS t, unnest(range(1, len(string_split(new_code, chr(10))) + 1)) AS n FROM eval_cases) WHERE contains(t, 'assert') GROUP BY 1",
    "h10_guides": f"""WITH c AS (SELECT DISTINCT id, repository_id, language, path, start_line, symbol, content FROM code_chunks),
        n AS (SELECT DISTINCT repository_id, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, {V.QUERY_TERMS})) AS word FROM (SELECT repository_id, list_filter(flatten(list_transform(
          regexp_extract_all(symbol, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: string_split(lower(x), '_'))), lambda x: length(x) > 2 AND NOT list_contains({_list(V.STOP_WORDS)}, x)) AS l FROM c WHERE symbol IS NOT NULL AND language <> 'markdown')),
        d AS (SELECT DISTINCT repository_id, id, path, start_line, unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) AS word FROM c WHERE language = 'markdown'),
        k AS (SELECT repository_id, id, path, start_line, count(*) AS shared FROM d SEMI JOIN n USING (repository_id, word) GROUP BY ALL)
        SELECT repository_id, rank, id, shared FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY shared DESC, path, start_line, id)::INT AS rank FROM k) WHERE rank <= 2""",
    "f13_rollup": """SELECT coalesce(language, '(all)') AS language, coalesce(status, '(all)') AS status, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions
        FROM (SELECT DISTINCT id, coalesce(language, 'none') AS language, status, additions, deletions FROM changed_files) GROUP BY ROLLUP (language, status)""",
    "b4_identities": """SELECT count(*) AS kept, sum(n - 1)::BIGINT AS refused FROM (SELECT count(*) AS n FROM (SELECT DISTINCT id, repository_id, blob_sha, chunker_version, start_line, symbol_type, qualified_name FROM code_chunks)
        GROUP BY repository_id, blob_sha, chunker_version, start_line, symbol_type, qualified_name)""",
}
