"""Queries: search over chunks, documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import fixed_values as V, text as T
from cairnlake.operators import search as S
from cairnlake.plans.text_queries import _list, chunks
from cairnlake.sources.tables import load


def _code(spark, d, *cols):
    return chunks(spark, d, "id", "repository_id", *cols)


def c1_definitions(spark, d):
    c = _code(spark, d, "symbol", "symbol_type", "called_names", "bases", "parent_symbol")
    return S.definitions_referenced(c).select("repository_id", "id", "symbol", "references")


def c2_symbols_in_paths(spark, d):
    """Per file the names it defines, and its module header's length."""
    c = _code(spark, d, "path", "symbol", "symbol_type", "start_line", "end_line")
    defs = c.filter(F.col("symbol_type").isin(*S.DEFINITIONS) | ((F.col("symbol_type") == "module") & (F.col("start_line") == 1)))
    return defs.groupBy("repository_id", "path").agg(F.count_if(F.col("symbol_type") != "module").alias("definitions"), F.max(F.when(F.col("symbol_type") == "module", F.col("end_line"))).alias("header_end"))


def c3_callers(spark, d):
    return S.callers(_code(spark, d, "path", "start_line", "symbol_type", "is_test", "called_names")).select("repository_id", "name", "rank", "id")


def c4_tests(spark, d):
    return S.tests_of(_code(spark, d, "path", "start_line", "symbol", "symbol_type", "is_test", "called_names")).select("repository_id", "name", "rank", "id")


def c5_docs(spark, d):
    c = _code(spark, d, "path", "language", "token_count").filter("language = 'markdown'")
    hit = F.lit(False)
    for p in V.GUIDE_PATHS:
        hit = hit | F.col("path").ilike(p)
    return c.groupBy("repository_id", hit.alias("is_guide")).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def _titles(spark, d):
    q = load(spark, d, "eval_cases", "case_id", "title").select("case_id", T.query_terms(F.col("title")).alias("terms"))
    return q, load(spark, d, "documents", "doc_id", "text"), "case_id", "doc_id", "text"


def h1_lexical_topk(spark, d):
    return S.lexical_top(*_titles(spark, d), k=10).select("case_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def c6_matching_documents(spark, d):
    """Documents per item that hold all of its title's terms, or all but one."""
    return S.matching_counts(*_titles(spark, d), missing=1)


def c7_similar_parts(spark, d):
    p = load(spark, d, "part", "p_partkey", "p_name")
    q = p.filter(F.col("p_partkey") % 100 == 0).select(F.col("p_name").alias("query")).distinct()
    s = S.similar_names(q, p.select(F.col("p_name").alias("name")).distinct(), 0.6)
    return S.top(s, ["query"], [F.desc(F.round("similarity", 9)), F.col("name")], 10).select("query", "rank", "name", F.round("similarity", 6).alias("similarity"))


def h2_vector_topk(spark, d):
    e = load(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return S.nearest(e.filter(F.col("id") % 100 == 0), e, 10).select("query_id", "rank", "id", F.round("cosine", 6).alias("cosine"))


def j26_boosts(spark, d):
    """Boosts of every chunk when the tests of its repository are taken as the change."""
    c = _code(spark, d, "path", "symbol", "symbol_type", "qualified_name", "called_names", "imports", "is_test", "token_count")
    change = c.filter("is_test")
    called = change.select("repository_id", F.explode("called_names").alias("symbol")).distinct().withColumn("called", F.lit(True))
    dirs = change.select("repository_id", T.parent_dir(F.col("path")).alias("dir")).distinct().withColumn("same_dir", F.lit(True))
    named = change.select("repository_id", F.explode("called_names").alias("qualified_name")).distinct().withColumn("exact", F.lit(True))
    imports = change.select("repository_id", F.explode("imports").alias("import")).distinct()
    imported = S.import_targets(imports, c.select("repository_id", "path").distinct()).select("repository_id", "path").distinct().withColumn("imported", F.lit(True))
    symbols = change.filter(F.col("symbol_type").isin(*S.DEFINITIONS)).select("repository_id", F.col("symbol").alias("name")).distinct()
    tests = change.select("repository_id", "id", F.explode("called_names").alias("name")).join(symbols, ["repository_id", "name"], "left_semi").select("repository_id", "id").distinct().withColumn("tests", F.lit(True))
    rows = (c.withColumn("dir", T.parent_dir(F.col("path"))).join(called, ["repository_id", "symbol"], "left").join(dirs, ["repository_id", "dir"], "left")
            .join(named, ["repository_id", "qualified_name"], "left").join(imported, ["repository_id", "path"], "left").join(tests, ["repository_id", "id"], "left"))
    flags = rows.select("id", "symbol", "symbol_type", "token_count", *[F.coalesce(f, F.lit(False)).alias(f) for f in ("exact", "imported", "called", "same_dir", "tests")])
    total, reasons = S.boosts()
    return flags.select("id", F.round(total, 6).alias("boost"), reasons.alias("reasons"))


def d13_imports(spark, d):
    c = chunks(spark, d, "repository_id", "path", "imports")
    i = c.select("repository_id", F.explode("imports").alias("import")).distinct()
    # no chunk's import names a chunked file, so each file is also imported by its own module name
    own = c.filter(F.col("path").endswith(".py")).select("repository_id", F.concat(T.module_name(F.col("path")), F.lit(".symbol")).alias("import")).distinct()
    return S.import_targets(i.unionByName(own).distinct(), c.select("repository_id", "path").distinct())


def d17_parents(spark, d):
    """Methods with the class that holds them."""
    c = _code(spark, d, "blob_sha", "chunker_version", "symbol_type", "qualified_name", "parent_symbol")
    parent = c.filter("symbol_type = 'class'").select("repository_id", "blob_sha", "chunker_version", F.col("qualified_name").alias("parent_symbol"), F.col("id").alias("class_id"))
    m = c.filter("symbol_type = 'method'").join(parent, ["repository_id", "blob_sha", "chunker_version", "parent_symbol"])
    return m.groupBy("class_id").agg(F.count("*").alias("methods"), F.min("id").alias("first_method"))


QUERIES = {f.__name__: f for f in (c1_definitions, c2_symbols_in_paths, c3_callers, c4_tests, c5_docs, h1_lexical_topk, c6_matching_documents, c7_similar_parts, h2_vector_topk, j26_boosts, d13_imports, d17_parents)}

_C = "c AS (SELECT DISTINCT id, repository_id, path, symbol, symbol_type, qualified_name, called_names, is_test, token_count, start_line, end_line, language FROM code_chunks)"
_TERMS = f"""list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, {V.QUERY_TERMS}) AS terms FROM (SELECT case_id, list_filter(flatten(list_transform(regexp_extract_all(title, '[A-Za-z_][A-Za-z0-9_]*'),
  lambda x: string_split(lower(x), '_'))), lambda x: length(x) > 2 AND NOT list_contains({_list(V.STOP_WORDS)}, x)) AS l FROM eval_cases)"""
_HITS = f"""q AS (SELECT case_id, {_TERMS}), qt AS (SELECT DISTINCT case_id, unnest(terms) AS term FROM q),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL),
  hits AS (SELECT case_id, doc_id, sum(tf) * 0.1::DOUBLE AS score, count(*) AS matched FROM p JOIN qt USING (term) GROUP BY ALL)"""
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"

SQL = {
    "c1_definitions": """WITH c AS (SELECT DISTINCT id, repository_id, symbol, symbol_type, called_names, bases, parent_symbol FROM code_chunks),
        k AS (SELECT repository_id, name AS symbol, count(DISTINCT id) AS "references" FROM (SELECT repository_id, id, unnest(list_concat(called_names, bases, [parent_symbol])) AS name FROM c) WHERE name IS NOT NULL GROUP BY ALL)
        SELECT c.repository_id, c.id, c.symbol, k."references" FROM c JOIN k ON k.repository_id = c.repository_id AND k.symbol = c.symbol WHERE symbol_type IN ('function', 'method', 'class')""",
    "c2_symbols_in_paths": f"""WITH {_C} SELECT repository_id, path, count(*) FILTER (WHERE symbol_type <> 'module') AS definitions, max(end_line) FILTER (WHERE symbol_type = 'module') AS header_end FROM c
        WHERE symbol_type IN ('function', 'method', 'class') OR (symbol_type = 'module' AND start_line = 1) GROUP BY ALL""",
    "c3_callers": f"""WITH {_C}, k AS (SELECT DISTINCT repository_id, path, start_line, id, unnest(called_names) AS name FROM c WHERE NOT is_test AND symbol_type IN ('function', 'method'))
        SELECT repository_id, name, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, name ORDER BY path, start_line, id)::INT AS rank FROM k) WHERE rank <= 3""",
    "c4_tests": f"""WITH {_C}, k AS (SELECT DISTINCT repository_id, path, start_line, id, unnest(called_names) AS name FROM c WHERE is_test),
        n AS (SELECT repository_id, unnest(called_names) AS name FROM c WHERE NOT is_test UNION SELECT repository_id, symbol FROM c WHERE NOT is_test AND symbol_type IN ('function', 'method', 'class') AND symbol IS NOT NULL)
        SELECT repository_id, name, rank, id FROM (SELECT k.*, row_number() OVER (PARTITION BY repository_id, name ORDER BY path, start_line, id)::INT AS rank FROM k SEMI JOIN n USING (repository_id, name)) WHERE rank <= 3""",
    "c5_docs": f"""WITH {_C} SELECT repository_id, {' OR '.join(f"path ILIKE '{p}'" for p in V.GUIDE_PATHS)} AS is_guide, count(*) AS chunks, sum(token_count)::BIGINT AS tokens
        FROM c WHERE language = 'markdown' GROUP BY ALL""",
    "h1_lexical_topk": f"WITH {_HITS} SELECT case_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM hits) WHERE rank <= 10",
    "c6_matching_documents": f"WITH {_HITS} SELECT case_id, count(*) AS documents FROM hits JOIN (SELECT case_id, len(terms) AS n FROM q) USING (case_id) WHERE matched >= n - 1 GROUP BY 1",
    "c7_similar_parts": f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT p_name AS query FROM part WHERE p_partkey % 100 = 0),
        g AS (SELECT name, {_GRAMS.format('name')} AS b FROM n), h AS (SELECT query, {_GRAMS.format('query')} AS a FROM q),
        s AS (SELECT query, name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM h, g)
        SELECT query, rank, name, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, name)::INT AS rank FROM s WHERE similarity >= 0.6) WHERE rank <= 10""",
    "h2_vector_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT.format('e.embedding', 'q.embedding')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})) AS cosine
        FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
        SELECT query_id, rank, id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id)::INT AS rank FROM s) WHERE rank <= 10""",
    "j26_boosts": f"""WITH {_C}, ch AS (SELECT repository_id, unnest(called_names) AS name FROM c WHERE is_test), dd AS (SELECT DISTINCT repository_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM c WHERE is_test),
        f AS (SELECT id, symbol, symbol_type, token_count, coalesce((repository_id, qualified_name) IN (SELECT (repository_id, name) FROM ch), false) AS exact, coalesce((repository_id, symbol) IN (SELECT (repository_id, name) FROM ch), false) AS called,
          (repository_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END) IN (SELECT (repository_id, dir) FROM dd) AS same_dir FROM c),
        g AS (SELECT *, symbol_type = 'module' AND NOT exact AS modsec, token_count < 15 OR coalesce(list_contains({_list(V.GENERIC_SYMBOLS)}, symbol), false) AS gen FROM f)
        SELECT id, round(CASE WHEN exact THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN called THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN same_dir THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN modsec THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN gen THEN -0.2::DOUBLE ELSE 0 END, 6) AS boost,
          concat_ws(',', CASE WHEN exact THEN 'exact_symbol' END, CASE WHEN called THEN 'called_by_change' END, CASE WHEN same_dir THEN 'same_dir' END, CASE WHEN modsec THEN 'module_section' END, CASE WHEN gen THEN 'generic' END) AS reasons FROM g""",
    "d13_imports": """WITH c AS (SELECT DISTINCT repository_id, path, imports FROM code_chunks), i AS (SELECT DISTINCT repository_id, unnest(imports) AS import FROM c
          UNION SELECT repository_id, replace(regexp_replace(regexp_replace(path, '\\.[^./]*$', ''), '(^|/)__init__$', ''), '/', '.') || '.symbol' FROM c WHERE path LIKE '%.py'),
        n AS (SELECT repository_id, import, string_split(import, '.') AS parts, unnest(range(1, len(string_split(import, '.')) + 1)) AS n FROM i),
        k AS (SELECT n.*, o, root || array_to_string(list_slice(parts, 1, n), '/') || e AS path, array_to_string(list_slice(parts, n + 1, len(parts)), '.') AS symbol
          FROM n, (VALUES (0, '', '.py'), (1, '', '/__init__.py'), (2, 'src/', '.py'), (3, 'src/', '/__init__.py'), (4, 'lib/', '.py'), (5, 'lib/', '/__init__.py')) v(o, root, e)),
        r AS (SELECT k.*, row_number() OVER (PARTITION BY repository_id, import ORDER BY n DESC, o) AS rn FROM k SEMI JOIN c ON c.repository_id = k.repository_id AND c.path = k.path)
        SELECT repository_id, import, path, symbol FROM r WHERE rn = 1""",
    "d17_parents": """WITH c AS (SELECT DISTINCT id, repository_id, blob_sha, chunker_version, symbol_type, qualified_name, parent_symbol FROM code_chunks)
        SELECT k.id AS class_id, count(*) AS methods, min(m.id) AS first_method FROM c m JOIN c k ON k.repository_id = m.repository_id AND k.blob_sha = m.blob_sha AND k.chunker_version = m.chunker_version
          AND k.qualified_name = m.parent_symbol WHERE m.symbol_type = 'method' AND k.symbol_type = 'class' GROUP BY 1""",
}
