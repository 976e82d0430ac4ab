"""Queries: diffs, selections under a budget, merges, caps and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnlake.functions import classify as C, fixed_values as V, text as T
from cairnlake.operators import diff as D, folds as L
from cairnlake.plans.text_queries import _GEN, _LANG, _TEST, _q, changed, chunks
from cairnlake.sources.tables import load

FILE = ["repository_id", "blob_sha", "chunker_version"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return D.parse(changed(spark, d, "id", "patch"))


def l10_hunks(spark, d):
    return D.hunks(_lines(spark, d))


def l10_malformed(spark, d):
    """Patches that are cut off or malformed, by reason."""
    return _lines(spark, d).filter("problem is not null").groupBy("problem").agg(F.count("*").alias("patches"))


def g11_numbered_lines(spark, d):
    return _lines(spark, d).filter("hunk > 0").select("id", "hunk", "line", "kind", "old_no", "new_no", F.md5("text").alias("digest"))


def g4_added_ranges(spark, d):
    return D.ranges(_lines(spark, d).filter("kind = 'add'"), ["id"], "new_no")


def f17_line_sets(spark, d):
    """Per patch how many lines a comment may stand on, on either side."""
    n = _lines(spark, d).filter("hunk > 0")
    return n.groupBy("id").agg(F.countDistinct(F.when(F.col("kind") != "del", F.col("new_no"))).alias("right_lines"), F.countDistinct(F.when(F.col("kind") == "del", F.col("old_no"))).alias("left_lines"),
                               F.countDistinct(F.when(F.col("kind") == "add", F.col("new_no"))).alias("added_lines"))


def e3_rendered(spark, d):
    return D.render(_lines(spark, d)).select("id", F.md5("text").alias("digest"))


def _items(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return chunks(spark, d, "id", *FILE, "token_count", *cols)


def l1_tier_budget(spark, d):
    """Chunks of each file selected under 1500 tokens, tiers by kind of chunk."""
    tier = F.when(F.col("symbol_type") == "module", 1).when(F.col("symbol_type") == "class", 2).when(F.col("symbol_type") == "function", 3).when(F.col("symbol_type") == "method", 4).when(
        F.col("symbol_type") == "config", 5).otherwise(6)
    rows = _items(spark, d, "symbol_type").select(*FILE, F.col("id").alias("item"), tier.alias("tier"), F.col("token_count").cast("double").alias("score"), F.col("token_count").alias("size"))
    return L.select_by_tier(rows, FILE, 1500).select(F.col("item").alias("id"), "tier", "taken")


def l3_triage(spark, d):
    """Files of each job taken in order of priority, at most four and 60 changed lines; one that would overfill is skipped, but the first is always taken."""
    p = changed(spark, d, "id", "review_job_id", "path", "status", "additions", "deletions")
    c, n = F.col("path"), F.col("additions") + F.col("deletions")
    rows = p.select("review_job_id", F.col("id").alias("item"), n.alias("size"), F.round(C.priority(C.language(c), C.is_test(c), c, F.col("status"), n), 6).alias("priority"))
    return L.skip_fit(rows, ["review_job_id"], ["-priority", "item"], "item", "size", 60, most=4, first_always=True).select(F.col("item").alias("id"), "taken")


def l4_batches(spark, d):
    """Chunks of each file in order of line, put into batches of 400 tokens, of which three calls allow two."""
    rows = _items(spark, d, "start_line")
    return L.limited_batches(L.next_fit(rows, FILE, ["start_line", "id"], "id", "token_count", 400), 3).select("id", "batch", "skipped")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """A class reaches to the end of its last method."""
    c = _items(spark, d, "symbol_type", "start_line", "end_line", "qualified_name", "parent_symbol")
    ends = c.filter("parent_symbol is not null").groupBy(*FILE, F.col("parent_symbol").alias("qualified_name")).agg(F.max("end_line").alias("e"))
    return c.join(ends, [*FILE, "qualified_name"], "left").select(*FILE, F.col("id").alias("item"), F.when(F.col("symbol_type") == "class", 2).otherwise(4).alias("tier"),
                                                                 F.col("start_line").alias("first"), F.when(F.col("symbol_type") == "class", F.greatest("end_line", "e")).otherwise(F.col("end_line")).alias("last"))


def l2_contained(spark, d):
    return L.contained(_spans(spark, d), FILE).select(F.col("item").alias("id"), "outer", "dropped")


def d9_enclosing(spark, d):
    """For the first line of each chunk the shortest span around it."""
    s = _spans(spark, d)
    return L.smallest_enclosing(s.select(*FILE, F.col("first").alias("point")).distinct(), s, FILE)


def g7_capped(spark, d):
    """At most one file a folder and three a job, those with most additions first."""
    p = changed(spark, d, "id", "review_job_id", "path", "additions").withColumn("folder", T.parent_dir(F.col("path")))
    return L.capped(p, ["review_job_id"], ["folder"], [F.desc("additions"), F.col("id")], 1, 3).select("review_job_id", "n", "id")


def l7_deduplicated(spark, d):
    """Hunks of a patch that lie within three lines of a larger one and are of its kind or share its words."""
    h = l10_hunks(spark, d)
    grown = F.when(F.col("added") > 5, "large").otherwise("small")
    f = h.select("id", F.concat_ws("#", "id", "hunk").alias("item"), grown.alias("category"), F.col("new_start").alias("first"), (F.col("new_start") + F.col("new_len") + 60).alias("last"),
                 F.col("added").cast("double").alias("score"), (F.pmod(F.col("new_start"), F.lit(10)) / 10).alias("confidence"), F.col("hunk").alias("batch"), F.array(F.concat(F.lit("w"), F.col("added") % 3)).alias("words"))
    return L.deduplicate(f, ["id"])


def l8_matched(spark, d):
    """Ranges of added lines matched with the hunks that hold them, one to one in order."""
    lines = _lines(spark, d)
    want = D.ranges(lines.filter("kind = 'add'"), ["id"], "new_no").select("id", F.lpad(F.col("range_start").cast("string"), 6, "0").alias("item"), F.col("range_start").alias("first"), F.col("range_end").alias("last"))
    have = D.hunks(lines).select("id", F.lpad(F.col("hunk").cast("string"), 4, "0").alias("item"), F.col("new_start").alias("first"), (F.col("new_start") + F.col("new_len") - 1).alias("last"))
    return L.match_in_order(want, have, ["id"])


def _flags(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("path")
    p = changed(spark, d, "id", "repository_id", "path", "is_generated")
    return p.select("repository_id", C.is_generated(c).alias("expected"), F.coalesce("is_generated", F.lit(False)).alias("accepted"))


def f11_confusion(spark, d):
    e, a = F.col("expected"), F.col("accepted")
    return _flags(spark, d).groupBy("repository_id").agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count("*").alias("files"))


def f12_scores(spark, d):
    """Precision, recall and F1 of the stored flag against the path rule, per language and over all."""
    c = F.col("path")
    p = changed(spark, d, "id", "path", "is_generated").select(F.coalesce(C.language(c), F.lit("none")).alias("language"), C.is_generated(c).alias("e"), F.coalesce("is_generated", F.lit(False)).alias("a"))
    s = p.rollup("language").agg(F.count_if(F.col("e") & F.col("a")).alias("tp"), F.count_if(F.col("a")).alias("n_a"), F.count_if("e").alias("n_e"), F.count("*").alias("files"))
    ratio = lambda n, m: F.coalesce(F.try_divide(n, m), F.lit(0.0))
    return s.select(F.coalesce("language", F.lit("(all)")).alias("language"), "files", F.round(ratio(F.col("tp"), F.col("n_a")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("n_e")), 6).alias("recall"),
                    F.round(ratio(2 * F.col("tp"), F.col("n_a") + F.col("n_e")), 6).alias("f1"))


def f16_totals(spark, d):
    p = changed(spark, d, "id", "repository_id", "status", "additions", "deletions")
    return p.groupBy("repository_id", "status").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def d18_flagged_lines(spark, d):
    """Added lines that hold a marker, joined with the lines a comment may stand on."""
    lines = _lines(spark, d).filter("hunk > 0")
    marked = lines.filter(F.col("text").contains("return")).select("id", F.col("new_no").alias("line"))
    added = lines.filter("kind = 'add'").select("id", F.col("new_no").alias("line"))
    return marked.join(added, ["id", "line"], "left_semi").distinct()


QUERIES = {f.__name__: f for f in (l10_hunks, l10_malformed, g11_numbered_lines, g4_added_ranges, f17_line_sets, e3_rendered, l1_tier_budget, l3_triage, l4_batches, l2_contained, d9_enclosing,
                                   g7_capped, l7_deduplicated, l8_matched, f11_confusion, f12_scores, f16_totals, d18_flagged_lines)}

# lines of every patch; n numbers them, h the hunk they are in
_P = r"""p AS (SELECT DISTINCT id, patch FROM changed_files WHERE patch IS NOT NULL AND patch <> ''),
  raw AS (SELECT id, unnest(string_split(patch, chr(10))) AS t, unnest(range(1, len(string_split(patch, chr(10))) + 1)) AS n FROM p),
  x AS (SELECT *, regexp_full_match(t, '@@ -\d+(,\d+)? \+\d+(,\d+)? @@.*') AS head, max(n) OVER (PARTITION BY id) AS top FROM raw),
  y AS (SELECT *, sum(head::INT) OVER (PARTITION BY id ORDER BY n) AS h FROM x),
  hd AS (SELECT id, h, regexp_extract(t, '@@ -(\d+)', 1)::INT AS os, coalesce(nullif(regexp_extract(t, '@@ -\d+,(\d+)', 1), '')::INT, 1) AS ol,
     regexp_extract(t, '@@ -\d+(?:,\d+)? \+(\d+)', 1)::INT AS ns, coalesce(nullif(regexp_extract(t, '@@ -\d+(?:,\d+)? \+\d+,(\d+)', 1), '')::INT, 1) AS nl FROM y WHERE head),
  z AS (SELECT y.id, y.h, y.n, y.top, t, os, ol, ns, nl, CASE WHEN t LIKE '+%' THEN 'add' WHEN t LIKE '-%' THEN 'del' WHEN t LIKE ' %' OR t = '' THEN 'context' ELSE 'bad' END AS kind
     FROM y JOIN hd ON hd.id = y.id AND hd.h = y.h WHERE NOT head AND t NOT LIKE '\%'),
  c AS (SELECT *, count(*) FILTER (WHERE kind <> 'add') OVER w AS o, count(*) FILTER (WHERE kind <> 'del') OVER w AS w FROM z WINDOW w AS (PARTITION BY id, h)),
  k AS (SELECT * FROM c WHERE NOT (n = top AND t = '' AND (o > ol OR w > nl))),
  s AS (SELECT id, h, os, ol, ns, nl, count(*) FILTER (WHERE kind = 'add') AS added, count(*) FILTER (WHERE kind = 'del') AS removed, count(*) FILTER (WHERE kind = 'context') AS context, bool_or(kind = 'bad') AS bad FROM k GROUP BY ALL),
  f AS (SELECT hd.*, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(context, 0) AS context, coalesce(bad, false) AS bad FROM hd LEFT JOIN s ON s.id = hd.id AND s.h = hd.h),
  why AS (SELECT p.id, CASE WHEN EXISTS (SELECT 1 FROM y WHERE y.id = p.id AND h = 0 AND trim(t) <> '') THEN 'text before the first hunk'
     WHEN EXISTS (SELECT 1 FROM f WHERE f.id = p.id AND bad) THEN 'unknown line' WHEN EXISTS (SELECT 1 FROM f WHERE f.id = p.id AND (removed + context <> ol OR added + context <> nl)) THEN 'line counts' END AS problem FROM p),
  g AS (SELECT * FROM f WHERE id IN (SELECT id FROM why WHERE problem IS NULL) AND added + removed + context > 0),
  l AS (SELECT k.id, k.h AS hunk, row_number() OVER v AS line, kind, CASE WHEN kind <> 'add' THEN os + count(*) FILTER (WHERE kind <> 'add') OVER v - 1 END AS old_no,
     CASE WHEN kind <> 'del' THEN ns + count(*) FILTER (WHERE kind <> 'del') OVER v - 1 END AS new_no, substr(t, 2) AS text
     FROM k WHERE id IN (SELECT id FROM why WHERE problem IS NULL) WINDOW v AS (PARTITION BY id, h ORDER BY n))"""
_RANGES = "r AS (SELECT id, min(n) AS range_start, max(n) AS range_end FROM (SELECT id, n, n - row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM (SELECT DISTINCT id, new_no AS n FROM l WHERE kind = 'add')) GROUP BY id, i)"
_F = "repository_id, blob_sha, chunker_version"
_PRIO = f"""round(CASE WHEN lang = 'python' AND NOT test THEN 100.0 WHEN lang IN ('javascript', 'typescript', 'go', 'java', 'ruby', 'rust', 'sql') AND NOT test THEN 80.0 WHEN test THEN 40.0
  WHEN lang IN ('yaml', 'toml', 'json', 'ini', 'shell') THEN 30.0 ELSE 10.0 END + CASE WHEN regexp_matches(path, {_q(V.SENSITIVE_PATH)}) THEN 25.0 ELSE 0.0 END + CASE WHEN status = 'added' THEN 5.0 ELSE 0.0 END + least(n, 200) / 20, 6)"""
_SPANS = f"""c AS (SELECT DISTINCT id, {_F}, symbol_type, start_line, end_line, qualified_name, parent_symbol FROM code_chunks),
  e AS (SELECT {_F}, parent_symbol AS qualified_name, max(end_line) AS e FROM c WHERE parent_symbol IS NOT NULL GROUP BY ALL),
  sp AS (SELECT {_F}, id, CASE WHEN symbol_type = 'class' THEN 2 ELSE 4 END AS tier, start_line AS first, CASE WHEN symbol_type = 'class' THEN greatest(end_line, e) ELSE end_line END AS last FROM c LEFT JOIN e USING ({_F}, qualified_name))"""

SQL = {
    "l10_hunks": f"WITH {_P} SELECT id, h::INT AS hunk, os AS old_start, ol AS old_len, ns AS new_start, nl AS new_len, added, removed, context FROM g",
    "l10_malformed": f"WITH {_P} SELECT problem, count(*) AS patches FROM why WHERE problem IS NOT NULL GROUP BY 1",
    "g11_numbered_lines": f"WITH {_P} SELECT id, hunk::INT AS hunk, line::INT AS line, kind, old_no::INT AS old_no, new_no::INT AS new_no, md5(text) AS digest FROM l",
    "g4_added_ranges": f"WITH {_P}, {_RANGES} SELECT id, range_start::INT AS range_start, range_end::INT AS range_end FROM r",
    "f17_line_sets": f"WITH {_P} SELECT id, count(DISTINCT new_no) FILTER (WHERE kind <> 'del') AS right_lines, count(DISTINCT old_no) FILTER (WHERE kind = 'del') AS left_lines, count(DISTINCT new_no) FILTER (WHERE kind = 'add') AS added_lines FROM l GROUP BY 1",
    "e3_rendered": f"""WITH {_P} SELECT id, md5(string_agg(CASE WHEN kind = 'add' THEN lpad(new_no::VARCHAR, 6, ' ') || ' +     | ' || text WHEN kind = 'del' THEN lpad('-' || old_no, 6, ' ') || '       | ' || text
        ELSE lpad(new_no::VARCHAR, 6, ' ') || '       | ' || text END, chr(10) ORDER BY hunk, line)) AS digest FROM l GROUP BY 1""",
    "l8_matched": f"""WITH RECURSIVE {_P}, {_RANGES}, h AS (SELECT id, lpad(h::VARCHAR, 4, '0') AS item, ns AS first, ns + nl - 1 AS last FROM g),
        e AS (SELECT id, lpad(range_start::VARCHAR, 6, '0') AS item, range_start AS first, range_end AS last, row_number() OVER (PARTITION BY id ORDER BY range_start) AS k FROM r),
        m AS (SELECT e.id, e.item, e.k, coalesce(list(h.item ORDER BY h.item) FILTER (WHERE h.first <= e.last + 3 AND h.last >= e.first - 3), []) AS cand FROM e LEFT JOIN h ON h.id = e.id GROUP BY ALL),
        t AS (SELECT id, item, k, cand[1] AS hit, CASE WHEN len(cand) > 0 THEN [cand[1]] ELSE [] END AS used FROM m WHERE k = 1
          UNION ALL SELECT m.id, m.item, m.k, list_filter(m.cand, lambda x: NOT list_contains(t.used, x))[1], list_append(t.used, list_filter(m.cand, lambda x: NOT list_contains(t.used, x))[1]) FROM t JOIN m ON m.id = t.id AND m.k = t.k + 1)
        SELECT id, item, hit AS matched FROM t""",
    "l7_deduplicated": f"""WITH RECURSIVE {_P}, f0 AS (SELECT id, id || '#' || h AS item, CASE WHEN added > 5 THEN 'large' ELSE 'small' END AS category, ns AS first, ns + nl + 60 AS last, added AS score, (ns % 10) / 10.0::DOUBLE AS conf, h::INT AS batch, added % 3 AS w FROM g),
        ff AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, item) AS k FROM f0),
        t AS (SELECT id, item, k, NULL::VARCHAR AS kept_by, [{{'item': item, 'first': first, 'last': last, 'category': category, 'w': w}}] AS kept FROM ff WHERE k = 1
          UNION ALL SELECT f.id, f.item, f.k, list_filter(t.kept, lambda x: f.first <= x.last + 3 AND x.first <= f.last + 3 AND (x.category = f.category OR x.w = f.w))[1].item,
            CASE WHEN len(list_filter(t.kept, lambda x: f.first <= x.last + 3 AND x.first <= f.last + 3 AND (x.category = f.category OR x.w = f.w))) > 0 THEN t.kept
              ELSE list_append(t.kept, {{'item': f.item, 'first': f.first, 'last': f.last, 'category': f.category, 'w': f.w}}) END FROM t JOIN ff f ON f.id = t.id AND f.k = t.k + 1),
        d AS (SELECT t.id, t.item, t.k, kept_by, conf, batch FROM t JOIN ff f ON f.id = t.id AND f.item = t.item),
        n AS (SELECT id, kept_by AS item, max(conf) AS best, string_agg(batch::VARCHAR, ',' ORDER BY k) AS notes FROM d WHERE kept_by IS NOT NULL GROUP BY ALL)
        SELECT d.id, d.item, kept_by, round(greatest(conf, coalesce(best, conf)), 6) AS confidence, coalesce(notes, '') AS notes FROM d LEFT JOIN n ON n.id = d.id AND n.item = d.item""",
    "l1_tier_budget": f"""WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY {_F} ORDER BY tier, score DESC, id) AS n FROM (SELECT id, {_F}, CASE symbol_type WHEN 'module' THEN 1 WHEN 'class' THEN 2 WHEN 'function' THEN 3
          WHEN 'method' THEN 4 WHEN 'config' THEN 5 ELSE 6 END AS tier, token_count AS score, token_count AS size FROM (SELECT DISTINCT id, {_F}, symbol_type, token_count FROM code_chunks))),
        cap(tier, c) AS (VALUES (1, 375), (2, 300), (3, 150), (4, 225), (5, 300), (6, 75)),
        a AS (SELECT {_F}, id, tier, n, size, CASE WHEN tier = 1 THEN true ELSE size <= c AND size <= 1500 END AS take, CASE WHEN tier = 1 OR (size <= c AND size <= 1500) THEN size ELSE 0 END AS used,
            CASE WHEN tier <> 1 AND size <= c AND size <= 1500 THEN size ELSE 0 END AS spent FROM i JOIN cap USING (tier) WHERE n = 1
          UNION ALL SELECT i.repository_id, i.blob_sha, i.chunker_version, i.id, i.tier, i.n, i.size, t.take, a.used + CASE WHEN t.take THEN i.size ELSE 0 END, t.sp + CASE WHEN t.take AND i.tier <> 1 THEN i.size ELSE 0 END
            FROM a JOIN i ON i.repository_id = a.repository_id AND i.blob_sha = a.blob_sha AND i.chunker_version = a.chunker_version AND i.n = a.n + 1 JOIN cap ON cap.tier = i.tier,
            LATERAL (SELECT CASE WHEN i.tier = a.tier THEN a.spent ELSE 0 END AS sp, i.tier = 1 OR (CASE WHEN i.tier = a.tier THEN a.spent ELSE 0 END + i.size <= cap.c AND a.used + i.size <= 1500) AS take) t),
        u AS (SELECT {_F}, arg_max(used, n) AS used FROM a GROUP BY ALL),
        b AS (SELECT a.repository_id, a.blob_sha, a.chunker_version, a.id, a.tier, a.n, a.take OR u.used + a.size <= 1500 AS taken, u.used + CASE WHEN NOT a.take AND u.used + a.size <= 1500 THEN a.size ELSE 0 END AS used FROM a JOIN u USING ({_F}) WHERE n = 1
          UNION ALL SELECT a.repository_id, a.blob_sha, a.chunker_version, a.id, a.tier, a.n, a.take OR b.used + a.size <= 1500, b.used + CASE WHEN NOT a.take AND b.used + a.size <= 1500 THEN a.size ELSE 0 END
            FROM b JOIN a ON a.repository_id = b.repository_id AND a.blob_sha = b.blob_sha AND a.chunker_version = b.chunker_version AND a.n = b.n + 1)
        SELECT id, tier, taken FROM b""",
    "l3_triage": f"""WITH RECURSIVE f AS (SELECT id, review_job_id, n AS size, row_number() OVER (PARTITION BY review_job_id ORDER BY {_PRIO} DESC, id) AS k
          FROM (SELECT *, {_LANG} AS lang, {_TEST} AS test FROM (SELECT DISTINCT id, review_job_id, path, status, additions + deletions AS n FROM changed_files))),
        r AS (SELECT review_job_id, id, k, true AS taken, size AS used, 1 AS sel FROM f WHERE k = 1
          UNION ALL SELECT f.review_job_id, f.id, f.k, r.sel < 4 AND r.used + f.size <= 60, r.used + CASE WHEN r.sel < 4 AND r.used + f.size <= 60 THEN f.size ELSE 0 END, r.sel + CASE WHEN r.sel < 4 AND r.used + f.size <= 60 THEN 1 ELSE 0 END
            FROM r JOIN f ON f.review_job_id = r.review_job_id AND f.k = r.k + 1)
        SELECT id, taken FROM r""",
    "l4_batches": f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY {_F} ORDER BY start_line, id) AS k FROM (SELECT DISTINCT id, {_F}, token_count AS size, start_line FROM code_chunks)),
        r AS (SELECT {_F}, id, k, 0 AS batch, size AS used FROM f WHERE k = 1
          UNION ALL SELECT f.repository_id, f.blob_sha, f.chunker_version, f.id, f.k, CASE WHEN r.used > 0 AND r.used + f.size > 400 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used > 0 AND r.used + f.size > 400 THEN f.size ELSE r.used + f.size END
            FROM r JOIN f ON f.repository_id = r.repository_id AND f.blob_sha = r.blob_sha AND f.chunker_version = r.chunker_version AND f.k = r.k + 1)
        SELECT id, batch, CASE WHEN batch >= 2 THEN 'model_call_limit' END AS skipped FROM r""",
    "l2_contained": f"""WITH {_SPANS}, m AS (SELECT i.id, i.tier, o.id AS outer_id, o.tier AS outer_tier, row_number() OVER (PARTITION BY i.id ORDER BY o.id) AS n FROM sp i JOIN sp o USING ({_F})
        WHERE o.first <= i.first AND i.last <= o.last AND NOT (o.first = i.first AND o.last = i.last)) SELECT id, outer_id AS outer, outer_tier <= tier + 1 AS dropped FROM m WHERE n = 1""",
    "d9_enclosing": f"""WITH {_SPANS}, pt AS (SELECT DISTINCT {_F}, first AS point FROM sp), m AS (SELECT {_F}, point, id, row_number() OVER (PARTITION BY {_F}, point ORDER BY last - first, id) AS n FROM pt JOIN sp USING ({_F}) WHERE point BETWEEN first AND last)
        SELECT {_F}, point, id AS item FROM m WHERE n = 1""",
    "g7_capped": """WITH p AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM (SELECT DISTINCT id, review_job_id, path, additions FROM changed_files)),
        a AS (SELECT *, row_number() OVER (PARTITION BY review_job_id, folder ORDER BY additions DESC, id) AS i FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY review_job_id ORDER BY additions DESC, id)::INT AS n FROM a WHERE i <= 1)
        SELECT review_job_id, n, id FROM b WHERE n <= 3""",
    "f11_confusion": f"""WITH p AS (SELECT repository_id, {_GEN} AS e, coalesce(is_generated, false) AS a FROM (SELECT DISTINCT id, repository_id, path, is_generated FROM changed_files))
        SELECT repository_id, count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND a) AS fp, count(*) FILTER (WHERE e AND NOT a) AS fn, count(*) AS files FROM p GROUP BY 1""",
    "f12_scores": f"""WITH p AS (SELECT coalesce({_LANG}, 'none') AS language, {_GEN} AS e, coalesce(is_generated, false) AS a FROM (SELECT DISTINCT id, path, is_generated FROM changed_files)),
        s AS (SELECT language, count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE e) AS n_e, count(*) AS files FROM p GROUP BY ROLLUP (language))
        SELECT coalesce(language, '(all)') AS language, files, coalesce(round(tp / nullif(n_a, 0), 6), 0.0) AS precision, coalesce(round(tp / nullif(n_e, 0), 6), 0.0) AS recall, coalesce(round(2 * tp / nullif(n_a + n_e, 0), 6), 0.0) AS f1 FROM s""",
    "f16_totals": "SELECT repository_id, status, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM (SELECT DISTINCT id, repository_id, status, additions, deletions FROM changed_files) GROUP BY ALL",
    "d18_flagged_lines": f"WITH {_P} SELECT DISTINCT id, new_no::INT AS line FROM l WHERE kind = 'add' AND contains(text, 'return')",
}
