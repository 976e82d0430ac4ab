"""Context of a changed chunk: candidates in six tiers, merged and selected under a token budget.

1 the changed chunk, its class and its file's module header; 2 what it depends on: methods of its class that it reaches through self,
definitions of its own file that it calls, definitions it imports and uses, base classes; 3 callers; 4 tests that call it or are named
after its file, configuration and migrations that share its words; 5 hybrid search (lists fused by rank, boosted); 6 guides that share
most words. Each source is cut to its few best rows per changed chunk before the tiers come together, so a bundle is bounded by the sum
of those limits. Chunks of the changed file itself are left out of tiers 3 to 6.

Defined results: null names call, define and import nothing; ties go by path, line, id; repeated chunks count once for the caller to drop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairnlake.functions import fixed_values as V, text as T
from cairnlake.operators import folds, hybrid, search as S
from cairnlake.operators.search import DEFINITIONS, top
from cairnlake.session import durable

FILE = ["repository_id", "blob_sha", "chunker_version"]
#: Rows of each source per changed chunk, or per name where it says so.
LIMITS = {"imported": 4, "bases": 2, "callers": 3, "tests": 3, "config": 2, "migrations": 2, "similar": 8, "guides": 2}
CONFIG_LANGUAGES, MIGRATION_PATHS = ("yaml", "toml", "ini", "json", "dockerfile"), ("%migrat%", "%alembic%", "%schema%")
HEADER_TOKENS, GUIDE_TOKENS = 300, 400
#: Changed chunks, and documents, that meet in a task; so many of the words that most documents hold are multiplied; pairs counted at a time.
BLOCK_ROWS, COMMON_WORDS, SHARED_CELLS = 4_000, 512, 2_000_000
_PLACE = ["path", "start_line", "id"]


def _order() -> list[Column]:
    return [F.col(c) for c in _PLACE]


def _pick(rows: DataFrame, tier: int, score: float | Column, reason: str) -> DataFrame:
    return rows.select("bundle", F.col("id").alias("item"), F.lit(tier).alias("tier"), (F.lit(score) if not isinstance(score, Column) else score).cast("double").alias("score"), F.lit(reason).alias("reason"))


def _names(*columns: str) -> Column:
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])))


def own_file(ch: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tier 1."""
    own = _pick(ch.withColumn("id", F.col("bundle")), 1, 10.0, "changed_symbol")
    parents = chunks.filter("symbol_type = 'class'").select(*FILE, F.col("qualified_name").alias("parent_symbol"), "id")
    heads = chunks.filter(f"symbol_type = 'module' and start_line = 1 and token_count <= {HEADER_TOKENS}").select(*FILE, "id")
    return own.unionByName(_pick(ch.join(parents, [*FILE, "parent_symbol"]), 1, 9.0, "enclosing_class")).unionByName(_pick(ch.join(heads, FILE), 1, 5.0, "module_header"))


def imported_paths(ch: DataFrame, chunks: DataFrame) -> DataFrame:
    """(bundle, repository_id, path, symbol, alias): the files that a chunk's imports name, those whose last part it uses."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))
    used = F.array_union(words, F.transform(_names("called_names"), lambda n: F.element_at(F.split(n, r"\."), 1)))
    each = ch.select("bundle", "repository_id", F.explode(F.filter(_names("imports"), lambda i: F.array_contains(used, F.element_at(F.split(i, r"\."), -1)))).alias("import"))
    targets = S.import_targets(each.select("repository_id", "import").distinct(), chunks.select("repository_id", "path").distinct())
    return each.join(targets, ["repository_id", "import"]).select("bundle", "repository_id", "path", "symbol", F.element_at(F.split("import", r"\."), -1).alias("alias"))


def dependencies(ch: DataFrame, chunks: DataFrame, imported: DataFrame) -> DataFrame:
    """Tier 2."""
    calls = ch.select("bundle", *FILE, "qualified_name", F.explode(_names("called_names")).alias("call"))
    methods = chunks.filter("symbol_type = 'method'").select(*FILE, F.col("symbol").alias("name"), "id")
    siblings = calls.withColumn("name", F.regexp_extract("call", r"^(?:self|cls)\.(\w+)$", 1)).filter("name <> ''").join(methods, [*FILE, "name"]).filter("id <> bundle")
    defs = chunks.filter("symbol_type in ('function', 'class')").select(*FILE, F.col("qualified_name").alias("call"), "id")
    same = calls.filter(~F.col("call").contains(".") & ~F.col("call").eqNullSafe(F.col("qualified_name"))).drop("qualified_name").join(defs, [*FILE, "call"]).filter("id <> bundle")
    # an import of a name means that name, one of a module the attributes that are called on it
    attributes = ch.select("bundle", F.explode(_names("called_names")).alias("call")).filter(F.col("call").contains(".")).select(
        "bundle", F.split_part("call", F.lit("."), F.lit(1)).alias("alias"), F.split_part("call", F.lit("."), F.lit(2)).alias("attribute"))
    wanted = imported.filter("symbol <> ''").select("bundle", "repository_id", "path", F.col("symbol").alias("name")).unionByName(
        imported.filter("symbol = ''").join(attributes, ["bundle", "alias"]).select("bundle", "repository_id", "path", F.col("attribute").alias("name"))).distinct()
    known = chunks.select("repository_id", "path", "start_line", "id", F.explode(F.array_distinct(F.array_compact(F.array("symbol", "qualified_name")))).alias("name"))
    found = top(wanted.join(known, ["repository_id", "path", "name"]).filter("id <> bundle").select("bundle", *_PLACE).distinct(), ["bundle", "path"], _order(), LIMITS["imported"])
    classes = chunks.filter(F.col("symbol_type").isin(*DEFINITIONS)).select("repository_id", *_PLACE, F.explode(F.array_distinct(F.array_compact(F.array("symbol", "qualified_name")))).alias("name"))
    based = ch.select("bundle", "repository_id", F.col("path").alias("own_path"), F.explode(_names("bases")).alias("name")).join(classes, ["repository_id", "name"]).filter("path <> own_path")
    bases = top(based.select("bundle", *_PLACE).distinct(), ["bundle"], _order(), LIMITS["bases"])
    return (_pick(siblings, 2, 6.0, "sibling_method").unionByName(_pick(same, 2, 7.0, "same_pr_definition")).unionByName(_pick(found, 2, 8.0, "imported_definition")).unionByName(_pick(bases, 2, 5.0, "base_class")))


def usages(ch: DataFrame, chunks: DataFrame, imported: DataFrame) -> DataFrame:
    """Tier 3: those in imported files first. Per name the best of each file order are kept before they meet the changed chunks, but for
    the few in imported files, which are joined by file."""
    calls = chunks.filter("not is_test").select("repository_id", *_PLACE, F.explode(_names("called_names")).alias("own"))
    mine = ch.filter(F.col("symbol_type").isin(*DEFINITIONS)).select("bundle", "repository_id", "own", F.col("path").alias("own_path"))
    # a changed file's own callers are left out, so a name keeps as many as a file can hold of them besides
    first = calls.join(mine.select("repository_id", "own").distinct(), ["repository_id", "own"], "left_semi")
    ranked = mine.join(first, ["repository_id", "own"]).filter("path <> own_path")
    near = imported.select("bundle", "path").distinct().withColumn("near", F.lit(True))
    return _pick(top(ranked.join(near, ["bundle", "path"], "left"), ["bundle"], [F.col("near").isNull(), *_order()], LIMITS["callers"]), 3, 5.0, "calls")


def lexical(ch: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k rows of a repository that share most of a chunk's names, by frequency."""
    none = F.array().cast("array<string>")
    asked = ch.select("bundle", "repository_id", "path", F.coalesce(T.query_terms(F.array_join(_names("called_names", "owns"), " ")), none).alias("words"))
    docs = rows.select("repository_id", *_PLACE, F.coalesce(T.index_terms(F.col("content")), none).alias("words"))
    return most_shared(asked, docs, k, 1).withColumnRenamed("n", "s")


def validation(ch: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tier 4."""
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1)
    t = chunks.filter("is_test")
    calling = t.select("repository_id", *_PLACE, F.explode(_names("called_names")).alias("own")).join(
        ch.filter(F.col("symbol_type").isin(*DEFINITIONS)).select("bundle", "repository_id", "own", F.col("path").alias("own_path")), ["repository_id", "own"])
    named = t.filter("symbol_type in ('function', 'method')").select("repository_id", *_PLACE, F.regexp_replace(stem, "^test_|_test$|\\.test$|\\.spec$", "").alias("stem")).join(
        ch.filter("not is_test").select("bundle", "repository_id", F.col("path").alias("own_path"), stem.alias("stem")), ["repository_id", "stem"])
    tests = calling.select("bundle", "own_path", *_PLACE).unionByName(named.select("bundle", "own_path", *_PLACE)).filter("path <> own_path").drop("own_path").distinct()
    like = F.lit(False)
    for p in MIGRATION_PATHS:
        like = like | F.col("path").ilike(p)
    return (_pick(top(tests, ["bundle"], _order(), LIMITS["tests"]), 4, 6.0, "test_for_changed_symbol")
            .unionByName(_pick(lexical(ch, chunks.filter(F.col("language").isin(*CONFIG_LANGUAGES)), LIMITS["config"]), 4, 4.0, "config_match"))
            .unionByName(_pick(lexical(ch, chunks.filter(like), LIMITS["migrations"]), 4, 4.0, "migration_or_schema")))


def similar(ch: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tier 5."""
    q = ch.select(F.col("bundle").alias("id"), *[c for c in hybrid.COLUMNS if c != "id"])
    found = hybrid.retrieve(q, chunks, hybrid.lists(q, chunks), LIMITS["similar"])
    own = ch.select("bundle", F.col("path").alias("own_path"))
    out = found.join(chunks.select("id", "path"), "id").withColumnRenamed("query_id", "bundle").join(own, "bundle").filter("path <> own_path")
    return _pick(out, 5, F.col("score"), "hybrid")


def _most_shared(k: int, least: int):
    """The k documents of a piece that hold most often words of each changed chunk of a block, at least so often, first in order where they tie.
    Counts of the words that most documents hold come from a matrix product, those of the others from lists of the documents that hold them."""
    def run(table: pa.Table) -> pa.Table:
        docs = table.filter(table["is_doc"])
        docs = docs.take(pc.sort_indices(docs, sort_keys=[(c, "ascending") for c in _PLACE], null_placement="at_start"))
        changed = table.filter(pc.invert(table["is_doc"]))
        nd, held, asked = len(docs), docs["words"].combine_chunks(), changed["words"].combine_chunks()
        coded = held.flatten().dictionary_encode()
        each, tf = np.unique(np.asarray(coded.indices, np.int64) * max(1, nd) + np.asarray(pc.list_parent_indices(held), np.int64), return_counts=True)
        code, doc = each // max(1, nd), each % max(1, nd)
        df = np.bincount(code, minlength=len(coded.dictionary))
        place = np.empty_like(df)
        place[np.argsort(-df, kind="stable")] = np.arange(len(df))  # the words that most documents hold are the first
        code, df = place[code], np.sort(df)[::-1]
        doc, tf, code = (x[np.argsort(code, kind="stable")] for x in (doc, tf, code))
        first, common = np.cumsum(df) - df, min(COMMON_WORDS, len(df))
        kind = np.float32 if tf.sum() < 2**24 or np.bincount(doc, tf).max() < 2**24 else np.float64  # sums are exact
        dense = np.zeros((common, nd), kind)
        dense[code[code < common], doc[code < common]] = tf[code < common]
        known = pc.index_in(asked.flatten(), coded.dictionary)
        row, word = np.asarray(pc.list_parent_indices(asked), np.int64)[np.asarray(known.is_valid())], place[np.asarray(known.drop_null(), np.int64)]
        paths = docs["path"].combine_chunks().dictionary_encode()
        own = np.asarray(pc.fill_null(pc.index_in(changed["path"].combine_chunks(), paths.dictionary), -1))
        of = np.asarray(paths.indices)
        out_row, out_doc, out_n = [], [], []
        step = max(1, SHARED_CELLS // max(1, nd))
        for at in range(0, len(changed) if nd else 0, step):
            n = min(step, len(changed) - at)
            lo, hi = np.searchsorted(row, (at, at + n))
            r, w = row[lo:hi] - at, word[lo:hi]
            mine = np.zeros((n, common), kind)
            mine[r[w < common], w[w < common]] = 1
            shared = mine @ dense
            r, w = r[w >= common], w[w >= common]
            ends = np.cumsum(df[w])
            cuts = np.searchsorted(ends, np.arange(SHARED_CELLS, ends[-1] if len(ends) else 0, SHARED_CELLS))
            for x, y in zip(np.split(r, cuts), np.split(w, cuts)):
                m = df[y]
                if m.sum():
                    hit = np.repeat(first[y] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    shared += np.bincount(np.repeat(x, m) * nd + doc[hit], tf[hit], n * nd).reshape(n, nd)
            inside = np.flatnonzero(own[at:at + n] >= 0)
            shared[inside] = np.where(own[at + inside][:, None] == of[None, :], -1, shared[inside])
            each = np.arange(n)
            for _ in range(min(k, nd)):
                best = shared.argmax(axis=1)
                count = shared[each, best]
                shared[each, best] = -1
                out_row.append(at + each[count >= least])
                out_doc.append(best[count >= least])
                out_n.append(count[count >= least])
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        found = docs.select(_PLACE).take(pa.array(cat(out_doc)))
        return pa.table({"bundle": changed["bundle"].take(pa.array(cat(out_row))), **{c: found[c] for c in _PLACE}, "n": pa.array(cat(out_n))})
    return run


def most_shared(changed: DataFrame, docs: DataFrame, k: int, least: int = 0) -> DataFrame:
    """(bundle, path, start_line, id, n, rank): the k documents (repository_id, path, start_line, id, words), from other files of the repository,
    that hold most often words of each of (bundle, repository_id, path, words), at least so often. The changed chunks of a repository go in
    blocks and its documents in pieces, by hash; each block meets each piece in a task of its own, which keeps its k best, so pairs are never
    shuffled."""
    docs, changed = docs.filter("path is not null"), changed.filter("path is not null")
    size = lambda rows, name, most: rows.groupBy("repository_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    parts = size(changed, "blocks", BLOCK_ROWS).join(size(docs, "pieces", BLOCK_ROWS), "repository_id")
    at = lambda of, key: F.pmod(F.xxhash64(*key), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    none = lambda rows, c: F.lit(None).cast(rows.schema[c].dataType)
    a = changed.join(parts, "repository_id").select("repository_id", F.lit(False).alias("is_doc"), "bundle", "path", none(docs, "start_line").alias("start_line"), none(docs, "id").alias("id"), "words", at("blocks", ["bundle"]).alias("block"), each("pieces").alias("piece"))
    b = docs.join(parts, "repository_id").select("repository_id", F.lit(True).alias("is_doc"), none(changed, "bundle").alias("bundle"), *_PLACE, "words", each("blocks").alias("block"), at("pieces", ["id", "path"]).alias("piece"))
    kinds = {"bundle": changed, **dict.fromkeys(_PLACE, docs)}
    best = a.unionByName(b).groupBy("repository_id", "block", "piece").applyInArrow(_most_shared(k, least), ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c, rows in kinds.items()) + ", n bigint")
    return top(best, ["bundle"], [F.desc("n"), *_order()], k)


def guides(ch: DataFrame, chunks: DataFrame, paths: list[str] = V.GUIDE_PATHS) -> DataFrame:
    """Tier 6: of the repository's guides those that share most words with the change; where too few share any, the first of the others."""
    guide = F.lit(False)
    for p in paths:
        guide = guide | F.col("path").ilike(p)
    none = F.array().cast("array<string>")
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", F.array_join(_names("called_names", "owns"), " "), "content"), F.lit(r"([A-Za-z_]\w+)"), F.lit(1)), F.lower))
    docs = chunks.filter((F.col("language") == "markdown") & guide & (F.col("token_count") <= GUIDE_TOKENS)).select(
        "repository_id", *_PLACE, F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([a-z_]\w+)"), F.lit(1))), none).alias("words"))
    return _pick(most_shared(ch.select("bundle", "repository_id", "path", F.coalesce(words, none).alias("words")), docs, LIMITS["guides"]), 6, 2.0, "repository_guidelines")


def candidates(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """(bundle, item, tier, score, reason); bundle is the id of a changed chunk."""
    ch = changed.withColumnRenamed("id", "bundle").withColumn("own", F.col("symbol")).withColumn("owns", F.array("symbol"))
    imported = imported_paths(ch, chunks)
    parts = (own_file(ch, chunks), dependencies(ch, chunks, imported), usages(ch, chunks, imported), validation(ch, chunks), similar(ch, chunks), guides(ch, chunks))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def merged(rows: DataFrame) -> DataFrame:
    """One row per bundle and item: the best tier, the highest score, all reasons."""
    return rows.groupBy("bundle", "item").agg(F.min("tier").alias("tier"), F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def bundles(chunks: DataFrame, changed: DataFrame, budget: int) -> DataFrame:
    """(bundle, item, tier, score, reasons, taken, position): what of the candidates fits the budget; positions count the taken ones
    by tier, path and line."""
    c = durable(merged(candidates(chunks, changed)), "candidates")  # used twice
    sized = c.join(chunks.select(F.col("id").alias("item"), F.col("token_count").alias("size"), "path", "start_line"), "item")
    taken = folds.select_by_tier(sized.select("bundle", "item", "tier", F.round("score", 9).alias("score"), "size"), ["bundle"], budget).select("bundle", "item", "taken")
    out = sized.join(taken, ["bundle", "item"])
    place = F.row_number().over(W.partitionBy("bundle", "taken").orderBy("tier", "path", "start_line", "item"))
    return out.select("bundle", "item", "tier", F.round("score", 6).alias("score"), "reasons", "taken", F.when(F.col("taken"), place).alias("position"))
