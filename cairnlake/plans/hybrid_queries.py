"""Queries: hybrid retrieval for changed chunks, what each list adds, and how much of what is needed it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairnlake.functions import fixed_values as V
from cairnlake.operators import hybrid as H
from cairnlake.plans.search_queries import _DOT
from cairnlake.plans.text_queries import _list, chunks
from cairnlake.session import durable


def queries_of(c: DataFrame) -> DataFrame:
    """One definition in a hundred, by its content."""
    return c.filter(F.col("symbol_type").isin("function", "method", "class") & (F.conv(F.substring(F.sha2("content", 256), 1, 6), 16, 10).cast("bigint") % 100 == 0))


def _setup(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, chunks, lists), against all chunks."""
    c = chunks(spark, d, *H.COLUMNS)
    q = durable(queries_of(c), "queries")
    return q, c, durable(H.lists(q, c), "lists")


def f3_hybrid_rrf(spark, d):
    """The eight best chunks for each query."""
    q, c, ranked = _setup(spark, d)
    return H.retrieve(q, c, ranked).select("query_id", "rank", "id", F.round("score", 6).alias("score"), "found_by", "reasons")


def m9_ablation(spark, d):
    """How many of the eight best each list alone had among its own eight."""
    q, c, ranked = _setup(spark, d)
    best = H.retrieve(q, c, ranked).select("query_id", "id")
    return ranked.filter("rank <= 8").join(best, ["query_id", "id"]).groupBy("source").agg(F.count("*").alias("kept"), F.countDistinct("query_id").alias("queries"))


def f13_retrieval(spark, d):
    """Per mode how often the class that encloses a query's method is found, mean tokens, and hits per retrieved chunk."""
    q, c, ranked = _setup(spark, d)
    file = ["repository_id", "path"]
    named = chunks(spark, d, "id", *file, "symbol_type", "qualified_name", "parent_symbol")
    need = named.filter("symbol_type = 'class'").select(*file, F.col("qualified_name").alias("parent_symbol"), F.col("id").alias("wanted"))
    req = named.filter("symbol_type = 'method'").withColumnRenamed("id", "query_id").join(q.select(F.col("id").alias("query_id")), "query_id").join(need, [*file, "parent_symbol"]).select("query_id", "wanted")
    alone = ranked.filter("rank <= 8 and source <> 'exact'").join(c.select("id", "token_count"), "id").select(F.concat("source", F.lit("_only")).alias("mode"), "query_id", "id", "token_count")
    every = alone.unionByName(H.retrieve(q, c, ranked).select(F.lit("hybrid").alias("mode"), "query_id", "id", "token_count"))
    total = req.count()
    hit = every.join(req, (every["query_id"] == req["query_id"]) & (every["id"] == req["wanted"]), "left_semi").groupBy("mode").agg(F.count("*").alias("hits"))
    size = every.groupBy("mode").agg(F.count("*").alias("items"), F.sum("token_count").alias("tokens"), F.countDistinct("query_id").alias("queries"))
    ratio = lambda n, m: F.round(F.coalesce(F.try_divide(n, m), F.lit(0.0)), 6)
    h = F.coalesce("hits", F.lit(0))
    return size.join(hit, "mode", "left").select("mode", "queries", F.lit(total).cast("bigint").alias("required"), ratio(h, F.lit(total)).alias("hit_rate"), ratio(F.col("tokens"), F.col("queries")).alias("mean_tokens"), ratio(h, F.col("items")).alias("precision"))


QUERIES = {f.__name__: f for f in (f3_hybrid_rrf, m9_ablation, f13_retrieval)}

_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
_H = f"""c AS (SELECT DISTINCT id, repository_id, blob_sha, chunker_version, language, bases, path, start_line, symbol, qualified_name, symbol_type, signature, called_names, imports, is_test, token_count, content, content_hash, embedding, embedding_model, parent_symbol FROM code_chunks),
  q AS (SELECT * FROM c WHERE symbol_type IN ('function', 'method', 'class') AND ('0x' || substr(sha256(content), 1, 6))::BIGINT % 100 = 0),
  qt AS (SELECT id AS query_id, repository_id, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, {V.QUERY_TERMS})) AS term FROM (SELECT id, repository_id, list_filter(flatten(list_transform(
    regexp_extract_all(concat_ws(' ', qualified_name, signature), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: string_split(lower(x), '_'))), lambda x: length(x) > 2 AND NOT list_contains({_list(V.STOP_WORDS)}, x)) AS l FROM q)),
  ps AS (SELECT id, repository_id, path, start_line, term, count(*) AS tf FROM (SELECT id, repository_id, path, start_line, unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) AS term FROM c) WHERE term <> '' GROUP BY ALL),
  lx AS (SELECT query_id, ps.id, path, start_line, sum(tf) * 0.1::DOUBLE AS s FROM ps JOIN qt ON ps.repository_id = qt.repository_id AND ps.term = qt.term WHERE ps.id <> query_id GROUP BY ALL),
  vc AS (SELECT q.id AS query_id, c.id, c.path, c.start_line, {_DOT.format('c.embedding', 'q.embedding')} / (sqrt({_DOT.format('c.embedding', 'c.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})) AS s
    FROM c JOIN q ON c.repository_id = q.repository_id AND c.embedding_model = q.embedding_model AND len(c.embedding) = len(q.embedding) AND c.id <> q.id),
  qn AS (SELECT DISTINCT id AS query_id, repository_id, unnest(list_concat(called_names, [qualified_name, symbol])) AS name FROM q),
  ex AS (SELECT DISTINCT query_id, c.id, path, start_line FROM c JOIN qn ON c.repository_id = qn.repository_id AND (c.symbol = name OR c.qualified_name = name) WHERE c.id <> query_id),
  r AS (SELECT query_id, id, 'lexical' AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, path, start_line, id) AS rank FROM lx
    UNION ALL SELECT query_id, id, 'vector', row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, path, start_line, id) FROM vc WHERE s IS NOT NULL AND NOT isnan(s)
    UNION ALL SELECT query_id, id, 'exact', row_number() OVER (PARTITION BY query_id ORDER BY path, start_line, id) + 10 FROM ex),
  rk AS (SELECT query_id, id, source, CASE WHEN source = 'exact' THEN rank - 10 ELSE rank END AS rank FROM r WHERE rank <= 20),
  fu AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) * 60.0 AS score, string_agg(source || '#' || rank, ',' ORDER BY source || '#' || rank) AS found_by FROM rk GROUP BY ALL),
  im AS (SELECT DISTINCT q.id AS query_id, p.path FROM (SELECT id, repository_id, unnest(imports) AS i FROM q) q JOIN (SELECT DISTINCT repository_id, path FROM c) p ON p.repository_id = q.repository_id
    AND p.path IN (replace(i, '.', '/') || '.py', replace(i, '.', '/') || '/__init__.py', 'src/' || replace(i, '.', '/') || '.py', 'lib/' || replace(i, '.', '/') || '.py')),
  fl AS (SELECT fu.query_id, fu.id, fu.score, found_by, c.path, c.start_line, c.token_count, c.symbol_type, c.symbol, coalesce(list_contains(q.called_names, c.symbol), false) AS called,
      coalesce(list_contains(q.called_names, c.symbol), false) OR coalesce(list_contains(q.called_names, c.qualified_name), false) AS exact, (fu.query_id, c.path) IN (SELECT (query_id, path) FROM im) AS imported,
      {_DIR.format('c.path')} = {_DIR.format('q.path')} AS same_dir, coalesce(c.is_test AND list_contains(c.called_names, q.symbol), false) AS tests FROM fu JOIN c ON c.id = fu.id JOIN q ON q.id = fu.query_id),
  gl AS (SELECT *, symbol_type = 'module' AND NOT exact AS modsec, token_count < 15 OR coalesce(list_contains({_list(V.GENERIC_SYMBOLS)}, symbol), false) AS gen FROM fl),
  sc AS (SELECT *, round(score + (0.0::DOUBLE + CASE WHEN exact THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN imported THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN called THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN same_dir THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN tests THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN modsec THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN gen THEN -0.2::DOUBLE ELSE 0 END), 9) AS total,
      concat_ws(',', CASE WHEN exact THEN 'exact_symbol' END, CASE WHEN imported THEN 'imported_module' END, CASE WHEN called THEN 'called_by_change' END, CASE WHEN same_dir THEN 'same_dir' END,
        CASE WHEN tests THEN 'tests_changed_symbol' END, CASE WHEN modsec THEN 'module_section' END, CASE WHEN gen THEN 'generic' END) AS reasons FROM gl),
  best AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, path, start_line, id)::INT AS rank, id, total, found_by, reasons, token_count FROM sc QUALIFY rank <= 8)"""

SQL = {
    "f3_hybrid_rrf": f"WITH {_H} SELECT query_id, rank, id, round(total, 6) AS score, found_by, reasons FROM best",
    "m9_ablation": f"WITH {_H} SELECT source, count(*) AS kept, count(DISTINCT query_id) AS queries FROM rk JOIN best USING (query_id, id) WHERE rk.rank <= 8 GROUP BY 1",
    "f13_retrieval": f"""WITH {_H}, need AS (SELECT q.id AS query_id, c.id AS wanted FROM q JOIN c ON c.repository_id = q.repository_id AND c.path = q.path AND c.qualified_name = q.parent_symbol AND c.symbol_type = 'class' WHERE q.symbol_type = 'method'),
        ev AS (SELECT source || '_only' AS mode, query_id, id, token_count FROM rk JOIN c USING (id) WHERE rank <= 8 AND source <> 'exact' UNION ALL SELECT 'hybrid', query_id, id, token_count FROM best),
        h AS (SELECT mode, count(*) AS hits FROM ev WHERE (query_id, id) IN (SELECT (query_id, wanted) FROM need) GROUP BY 1), z AS (SELECT mode, count(*) AS items, sum(token_count) AS tokens, count(DISTINCT query_id) AS queries FROM ev GROUP BY 1)
        SELECT mode, queries, (SELECT count(*) FROM need) AS required, round(coalesce(coalesce(hits, 0) / nullif((SELECT count(*) FROM need), 0), 0.0)::DOUBLE, 6) AS hit_rate, round((tokens / queries)::DOUBLE, 6) AS mean_tokens,
          round((coalesce(hits, 0) / items)::DOUBLE, 6) AS precision FROM z LEFT JOIN h USING (mode)""",
}
