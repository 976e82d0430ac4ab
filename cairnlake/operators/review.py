"""Findings about changes: checking what they quote and replace, ranks, joins with verdicts, references and posted comments.

A finding has an id, the job it belongs to, a path, a category, a severity rank, a confidence and a range of lines.
Defined results: null quotes, paths and references are unknown, never matches; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairnlake.functions import text as T
from cairnlake.operators.search import top

#: Severities by rank, string prefixes that are no tokens, bounds of quotes and replacements, penalty for an unknown reference.
SEVERITIES = ("low", "medium", "high", "critical")
STRING_PREFIXES = ("f", "r", "b", "u", "fr", "rf", "br", "rb")
QUOTE_CHARS, QUOTE_TOKENS, TOKEN_CHARS, TOKEN_COVERAGE, LINE_SHARE = 6, 3, 12, 0.8, 0.9
REPLACEMENT_LINES, UNKNOWN_REFERENCE = 40, 0.7
#: The line-number gutter of a rendered diff.
GUTTER = r"^\s*(\d+\s*[+ ]\s*|-\d+\s*)\|\s?"


def strip_gutter(line: Column) -> Column:
    return F.regexp_replace(line, GUTTER, "")


def code_tokens(s: Column) -> Column:
    """Identifiers and numbers, without string prefixes that stand alone."""
    return F.filter(F.regexp_extract_all(s, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), lambda t: ~F.lower(t).isin(*STRING_PREFIXES))


def _long_enough(tokens: Column) -> Column:
    return (F.size(tokens) >= QUOTE_TOKENS) & (F.length(F.array_join(tokens, "")) >= TOKEN_CHARS)


def evidence(quote: Column, body: Column) -> Column:
    """How a quote is found in a text: 'verbatim', by 'lines', by 'tokens' (a run of four fifths of its tokens, the last of which may
    be cut), 'none', or 'short'."""
    lines = F.filter(F.transform(T.split_lines(quote), lambda x: T.collapse(strip_gutter(x))), lambda x: x != "")
    joined, whole = F.array_join(lines, " "), T.collapse(body)
    tokens = code_tokens(joined)
    text = F.concat(F.lit(" "), F.array_join(code_tokens(whole), " "))
    trims = F.floor(F.size(tokens) * (1 - TOKEN_COVERAGE) + 1e-9).cast("int")
    runs = F.flatten(F.transform(F.sequence(F.lit(0), trims), lambda a: F.transform(F.sequence(F.lit(0), trims - a), lambda b: F.slice(tokens, a + 1, F.size(tokens) - a - b))))
    found = F.exists(runs, lambda r: _long_enough(r) & text.contains(F.concat(F.lit(" "), F.array_join(r, " "))))
    share = F.size(F.filter(lines, lambda x: whole.contains(x))) / F.size(lines)
    return (F.when(F.coalesce(F.length(joined), F.lit(0)) < QUOTE_CHARS, "short").when(whole.contains(joined), "verbatim")
            .when((F.size(lines) > 1) & (share >= LINE_SHARE), "lines").when(_long_enough(tokens) & found, "tokens").otherwise("none"))


def normalized_path(path: Column, known: Column) -> Column:
    """The first form of a path that is in the array `known`: without quotes, without './', 'a/' or 'b/' in front; else null."""
    p = F.regexp_replace(F.trim(path), "^[`'\"]+|[`'\"]+$", "")
    forms = F.array(p, *[F.regexp_replace(p, x, "") for x in (r"^\./", "^a/", "^b/")])
    return F.get(F.filter(forms, lambda f: F.array_contains(known, f)), F.lit(0))


def replacement(code: Column, side: Column, first: Column, last: Column, added: Column) -> Column:
    """Why a suggested replacement of the lines first..last cannot stand, null if it can; added is the array of lines the change adds."""
    wanted = F.sequence(first, F.greatest(first, last))
    return (F.when(~F.coalesce(side == "RIGHT", F.lit(False)), "side").when(F.trim(F.coalesce(code, F.lit(""))) == "", "blank").when(code.contains("```"), "fence")
            .when(F.size(F.split(F.regexp_replace(code, "\n$", ""), "\n")) > REPLACEMENT_LINES, "long").when(F.size(F.array_except(wanted, added)) > 0, "not_added"))


def ranked(findings: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Findings with their position in each group."""
    return findings.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def by_rank() -> list[Column]:
    """Order of findings by weight."""
    return [F.desc(F.col("severity") * 10 + F.col("confidence")), F.col("id")]


def by_publishing() -> list[Column]:
    """Order of comments as they are posted."""
    return [F.desc("severity"), F.desc("confidence"), F.col("path"), F.col("first"), F.col("id")]


def with_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates (job, n) that no verdict (job, n, keep) rejects; verdicts on unknown numbers change nothing."""
    told = verdicts.groupBy("job", "n").agg(F.min("keep").alias("keep"))
    return candidates.join(told, ["job", "n"], "left").filter(F.coalesce("keep", F.lit(True))).drop("keep")


def checked_references(findings: DataFrame, bundles: DataFrame) -> DataFrame:
    """Findings (id, job, refs, confidence) with their unknown references and the confidence after the penalty; bundles is (job, known array)."""
    j = findings.join(bundles, "job", "left").withColumn("unknown", F.array_except("refs", F.coalesce("known", F.array().cast("array<string>"))))
    return j.withColumn("confidence", F.round(F.col("confidence") * F.when(F.size("unknown") > 0, UNKNOWN_REFERENCE).otherwise(1.0), 4)).drop("known")


def reference_labels(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, labels): 'path:first-last' of every chunk that a row (id, ref) names, sorted."""
    c = chunks.select(F.col("id").alias("ref"), F.format_string("%s:%d-%d", "path", "start_line", "end_line").alias("label"))
    return refs.join(c, "ref").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def current_heads(jobs: DataFrame) -> DataFrame:
    """Jobs whose head is still that of the last job of the pull request; the others are stale."""
    last = jobs.groupBy("repository_id", "pull_number").agg(F.max(F.struct("created_at", "id", "head_sha")).alias("m")).select("repository_id", "pull_number", F.col("m.head_sha").alias("head_sha"))
    return jobs.join(last, ["repository_id", "pull_number", "head_sha"], "left_semi")


def usage_ledger(jobs: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """Tokens and calls per group, and the last `most` ids in order of time; only those are collected."""
    total = jobs.groupBy(*by).agg(F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.count("*").alias("calls"))
    last = top(jobs, by, [F.desc("created_at"), F.desc("id")], most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("l"))
    return total.join(last.select(*by, F.array_join(F.col("l.id"), ",").alias("last_ids")), by)


def sibling_calls(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(id, name, target): calls of self.name or cls.name by a method, and the method of its class in the same file."""
    m = chunks.filter("symbol_type = 'method'")
    calls = m.select("id", *keys, "parent_symbol", F.explode(F.array_distinct("called_names")).alias("call")).withColumn("name", F.regexp_extract("call", r"^(?:self|cls)\.(\w+)$", 1))
    target = m.select(*keys, "parent_symbol", F.col("symbol").alias("name"), F.col("id").alias("target"))
    return calls.filter("name <> ''").join(target, [*keys, "parent_symbol", "name"]).filter("id <> target").select("id", "name", "target")


def alias_calls(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """(id, call, target): calls of alias.name, where imports (repository_id, id, alias, path) says which file the alias is, and the definition there."""
    calls = chunks.select("repository_id", "id", F.explode(F.array_distinct("called_names")).alias("call")).filter(F.col("call").contains("."))
    calls = calls.withColumn("alias", F.split_part("call", F.lit("."), F.lit(1))).withColumn("symbol", F.split_part("call", F.lit("."), F.lit(2)))
    defs = chunks.filter(F.col("symbol_type").isin("function", "class")).select("repository_id", "path", "symbol", F.col("id").alias("target"))
    return calls.join(imports, ["repository_id", "id", "alias"]).join(defs, ["repository_id", "path", "symbol"]).select("id", "call", "target")


def outcomes(batches: DataFrame, by: list[str]) -> DataFrame:
    """'complete', 'partial' or 'failed' for each group of batches (ok): some that failed leave a partial result."""
    return batches.groupBy(*by).agg(F.count_if("ok").alias("good"), F.count("*").alias("batches")).select(
        *by, "batches", F.when(F.col("good") == F.col("batches"), "complete").when(F.col("good") > 0, "partial").otherwise("failed").alias("outcome"))


def merged_spans(rows: DataFrame, span: list[str]) -> DataFrame:
    """Rows (span..., tier, score, reason, position) of the same span as one: the best tier, the highest score, and each reason once, in order of
    first appearance. Reasons are cut to their first appearance before they are collected."""
    best = rows.groupBy(*span).agg(F.min("tier").alias("tier"), F.max("score").alias("score"), F.count("*").alias("merged"))
    firsts = rows.groupBy(*span, "reason").agg(F.min("position").alias("position"))
    why = firsts.groupBy(*span).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "reason"))), lambda x: x["reason"]), ",").alias("reasons"))
    cond = [best[c].eqNullSafe(why[c]) for c in span]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return best.join(why, on).select(*[best[c] for c in span], "tier", "score", "merged", "reasons")
