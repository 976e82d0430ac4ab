"""Queries: chunking and embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.functions import text as T
from cairnlake.operators import chunkers, embed
from cairnlake.plans.text_queries import chunks
from cairnlake.sources.tables import load


def _python_files(spark: SparkSession, d: str) -> DataFrame:
    """Python files put together from their chunks in order of line, each from the newest chunker version it has."""
    c = load(spark, d, "code_chunks", "repository_id", "blob_sha", "chunker_version", "path", "language", "start_line", "content").filter("language = 'python'")
    # versions are numbers, '10' being newer than '9'; in the sorted chunks those of the newest come last
    version = F.struct(F.expr("try_cast(chunker_version as bigint)").alias("n"), "chunker_version").alias("version")
    g = c.groupBy("repository_id", "blob_sha", "path").agg(F.array_sort(F.collect_set(F.struct(version, "start_line", "content"))).alias("c"))
    g = g.withColumn("c", F.filter("c", lambda x: x["version"].eqNullSafe(F.element_at("c", -1)["version"])))
    return g.select("repository_id", "blob_sha", "path", F.array_join(F.transform("c", lambda x: x["content"]), "\n").alias("source"))


def m2_python_chunks(spark, d):
    """Chunks of the Python files, counted per file and kind."""
    c = chunkers.python_chunks(_python_files(spark, d).select(F.concat_ws("|", "repository_id", "path").alias("path"), "source"))
    return c.groupBy("path", "symbol_type").agg(F.count("*").alias("chunks"), F.sum(T.estimate_tokens(F.col("content"))).alias("tokens"))


def m4_sections(spark, d):
    """Sections of every document read as Markdown."""
    f = load(spark, d, "documents", "doc_id", "text").select("doc_id", F.lit("markdown").alias("language"), "text")
    return chunkers.sections(f, key="doc_id", source="text").select(F.col("key").alias("doc_id"), "start_line", "end_line", "symbol", F.md5("content").alias("digest"))


def j11_hash_embeddings(spark, d):
    """Feature-hash vectors of the chunks' names."""
    c = chunks(spark, d, "id", "qualified_name").filter("qualified_name is not null")
    return c.select("id", embed.embed(F.col("qualified_name"), 128).alias("embedding"))


def j11_jvm_embeddings(spark, d):
    c = chunks(spark, d, "id", "qualified_name").filter("qualified_name is not null")
    return c.select("id", F.size(embed.jvm_embed(F.col("qualified_name"))).alias("buckets"))


def e2_embedding_text(spark, d):
    """The text of a chunk that is embedded, and its cache key; the line of the name is left out where there is none."""
    c = chunks(spark, d, "id", "path", "symbol_type", "qualified_name", "signature", "content")
    t = F.substring(F.concat_ws("\n", F.concat(F.lit("# "), "path"), F.concat(F.lit("# "), "symbol_type", F.lit(" "), "qualified_name"), "signature", "content"), 1, 6000)
    return c.select("id", F.sha2(t, 256).alias("cache_key"), F.length(t).alias("chars"))


QUERIES = {f.__name__: f for f in (m2_python_chunks, m4_sections, j11_hash_embeddings, j11_jvm_embeddings, e2_embedding_text)}

SQL = {
    "m4_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, len(string_split(text, chr(10))) AS top, text FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents)),
        x AS (SELECT doc_id, t, n, nullif(regexp_extract(t, '^#{1,4}[ \t\n\r\f\x0b]+(.*[^ \t\n\r\f\x0b])[ \t\n\r\f\x0b]*$', 1), '') AS title FROM l WHERE NOT (n = top AND t = '')),
        y AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM x),
        z AS (SELECT doc_id, s, min(n) AS a, max(n) FILTER (WHERE trim(t, ' ' || chr(9) || chr(13)) <> '') AS b, coalesce(max(title), '<preamble>') AS symbol FROM y GROUP BY ALL),
        w AS (SELECT doc_id, a + k * 80 AS start_line, least(b, a + k * 80 + 79) AS end_line, symbol FROM (SELECT *, unnest(range(0, (b - a) // 80 + 1)) AS k FROM z WHERE b IS NOT NULL))
        SELECT w.doc_id, start_line::INT AS start_line, end_line::INT AS end_line, symbol, md5(string_agg(t, chr(10) ORDER BY n)) AS digest FROM w JOIN x ON x.doc_id = w.doc_id AND n BETWEEN start_line AND end_line GROUP BY ALL""",
    "e2_embedding_text": """SELECT id, sha256(t) AS cache_key, length(t) AS chars FROM (SELECT id, substr(concat_ws(chr(10), '# ' || path, '# ' || symbol_type || ' ' || qualified_name, signature, content), 1, 6000) AS t
        FROM (SELECT DISTINCT id, path, symbol_type, qualified_name, signature, content FROM code_chunks))""",
}
