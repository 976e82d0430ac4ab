"""Structural, lexical, trigram and vector search, and their fusion by rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairnlake.functions import fixed_values as V, text as T

DEFINITIONS = ("function", "method", "class")
#: Share of the score that one occurrence of a term has.
TERM_WEIGHT = 0.1


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; groups are cut before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def definitions_referenced(chunks: DataFrame) -> DataFrame:
    """Definitions of a repository that other chunks call, inherit from or lie in, with the number of those chunks. They are
    counted per name before the join, so a name that everybody uses stays one row."""
    names = F.array_distinct(F.array_compact(F.concat(F.coalesce("called_names", F.array()), F.coalesce("bases", F.array()), F.array("parent_symbol"))))
    refs = chunks.select("repository_id", "id", F.explode(names).alias("symbol")).groupBy("repository_id", "symbol").agg(F.count("*").alias("references"))
    defs = chunks.filter(F.col("symbol_type").isin(*DEFINITIONS) & F.col("symbol").isNotNull())
    return defs.join(refs, ["repository_id", "symbol"])


def callers(chunks: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` calling functions or methods, no tests, per called name, in order of path and line."""
    c = chunks.filter(~F.col("is_test") & F.col("symbol_type").isin("function", "method"))
    calls = c.select("repository_id", "path", "start_line", "id", F.explode(F.array_distinct("called_names")).alias("name"))
    return top(calls, ["repository_id", "name"], [F.col("path"), F.col("start_line"), F.col("id")], most)


def tests_of(chunks: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` test chunks per name that code outside the tests defines or calls and they call too."""
    tests = chunks.filter("is_test").select("repository_id", "path", "start_line", "id", F.explode(F.array_distinct("called_names")).alias("name"))
    code = chunks.filter(~F.col("is_test"))
    names = code.select("repository_id", F.explode("called_names").alias("name")).unionByName(
        code.filter(F.col("symbol_type").isin(*DEFINITIONS) & F.col("symbol").isNotNull()).select("repository_id", F.col("symbol").alias("name"))).distinct()
    return top(tests.join(names, ["repository_id", "name"], "left_semi"), ["repository_id", "name"], [F.col("path"), F.col("start_line"), F.col("id")], most)


#: Up to so many distinct query terms are broadcast.
TERMS_BROADCAST = 1_000_000


def postings(docs: DataFrame, key: str, *text: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf); with terms (term) only those, all others being dropped before anything is shuffled. The terms are counted
    before they are broadcast."""
    each = docs.select(key, F.explode(T.index_terms(*[F.col(t) for t in text])).alias("term"))
    if terms is not None:
        wanted = terms.select("term").distinct()
        each = each.join(F.broadcast(wanted) if wanted.count() <= TERMS_BROADCAST else wanted, "term", "left_semi")
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"))


def lexical(queries: DataFrame, docs: DataFrame, query: str, key: str, *text: str) -> DataFrame:
    """(query, key, score, matched) of the documents that hold a query term; queries has (query, terms)."""
    terms = queries.select(query, F.explode("terms").alias("term")).distinct()
    posts = postings(docs, key, *text, terms=terms)
    return posts.join(terms, "term").groupBy(query, key).agg((F.sum("tf") * TERM_WEIGHT).alias("score"), F.count("*").alias("matched"))


def _term_index(queries: DataFrame, query: str):
    """(query ids, terms, first, members): the queries of term t are members[first[t]:first[t + 1]]. The caller has counted the terms."""
    t = queries.select(query, F.explode("terms").alias("term")).distinct().toArrow()
    ids, terms = t.column(query).combine_chunks().dictionary_encode(), t.column("term").combine_chunks().dictionary_encode()
    code = np.asarray(terms.indices)
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1))
    return ids.dictionary, terms.dictionary, first, np.asarray(ids.indices)[order]


#: Cells of the matrix of documents and queries that is filled at a time.
SCORE_CELLS = 4_000_000


def _scores(batches: Iterator[pa.RecordBatch], index) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, document, query, frequency, matched terms) of every document of a batch (key, terms) that holds a term of a query."""
    ids, terms, first, members = index
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            b = whole.slice(at, step)
            lists = b.column(1)
            term = pc.index_in(lists.flatten(), terms)
            doc = np.asarray(pc.list_parent_indices(lists), np.int64)
            known = np.asarray(term.is_valid())
            pair, tf = np.unique(doc[known] * len(terms) + np.asarray(term.drop_null(), np.int64), return_counts=True)
            d, t = pair // max(1, len(terms)), pair % max(1, len(terms))
            n = first[t + 1] - first[t]
            owner = np.repeat(np.arange(len(t)), n)
            q = members[np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            cell = d[owner] * len(ids) + q
            total, matched = np.bincount(cell, tf[owner], b.num_rows * len(ids)), np.bincount(cell, minlength=b.num_rows * len(ids))
            hit = np.flatnonzero(matched)
            yield b.column(0), hit // max(1, len(ids)), hit % max(1, len(ids)), total[hit], matched[hit]


def lexical_top(queries: DataFrame, docs: DataFrame, query: str, key: str, *text: str, k: int) -> DataFrame:
    """(query, key, score, rank): the k documents of each query with the highest scores. The terms of a stated query set are counted and
    sent to the executors; each partition of documents keeps its k best for each query, and only those are shuffled. Beyond
    TERMS_BROADCAST terms documents and queries meet by term."""
    kind = docs.schema[key].dataType.simpleString()
    n = queries.select(F.sum(F.size("terms"))).first()[0] or 0
    if n > TERMS_BROADCAST:
        return top(lexical(queries, docs, query, key, *text), [query], [F.desc(F.round("score", 6)), F.col(key)], k)
    index = docs.sparkSession.sparkContext.broadcast(_term_index(queries, query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for keys, d, q, total, _ in _scores(batches, index.value):
            t = pd.DataFrame({"q": q, "s": total, "k": keys.take(pa.array(d)).to_pandas()})
            best = pd.concat([best, t]) if best is not None else t
            best = best.sort_values(["q", "s", "k"], ascending=[True, False, True]).groupby("q").head(k)
        if best is not None and len(best):
            ids = index.value[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best["q"].to_numpy())), pa.array(best["k"].to_numpy()), pa.array(best["s"].to_numpy() * TERM_WEIGHT)], names=[query, key, "score"])
    few = docs.select(key, T.index_terms(*[F.col(t) for t in text]).alias("terms")).filter(F.col("terms").isNotNull()).mapInArrow(run, f"{query} {queries.schema[query].dataType.simpleString()}, {key} {kind}, score double")
    return top(few, [query], [F.desc(F.round("score", 6)), F.col(key)], k)


def matching_counts(queries: DataFrame, docs: DataFrame, query: str, key: str, *text: str, missing: int = 0) -> DataFrame:
    """(query, documents): in how many documents all of a query's terms are, but for `missing`; counted within partitions first."""
    sizes = queries.select(query, F.size("terms").alias("n"))
    n = queries.select(F.sum(F.size("terms"))).first()[0] or 0
    if n > TERMS_BROADCAST:
        return lexical(queries, docs, query, key, *text).join(sizes, query).filter(F.col("matched") >= F.col("n") - missing).groupBy(query).agg(F.count("*").alias("documents"))
    index = docs.sparkSession.sparkContext.broadcast(_term_index(queries, query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, _, members = index.value
        need = np.bincount(members, minlength=len(ids)) - missing
        found = np.zeros(len(ids), np.int64)
        for _, _, q, _, matched in _scores(batches, index.value):
            found += np.bincount(q[matched >= need[q]], minlength=len(ids))
        got = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(got)), pa.array(found[got])], names=[query, "documents"])
    each = docs.select(key, T.index_terms(*[F.col(t) for t in text]).alias("terms")).filter(F.col("terms").isNotNull()).mapInArrow(run, f"{query} {queries.schema[query].dataType.simpleString()}, documents bigint")
    return each.groupBy(query).agg(F.sum("documents").alias("documents"))


def similar_names(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(query, name, similarity): trigram similarity of at least `least`. Sets that similar share one of their rarest trigrams: of n
    only the n - ceil(least * n) + 1 rarest are joined, in the order of how many names hold them, so a common trigram joins little;
    the pairs that meet are compared by their whole sets."""
    n = names.select("name", T.trigrams(F.col("name")).alias("b"))
    q = queries.select("query", T.trigrams(F.col("query")).alias("a"))
    held = n.select(F.explode("b").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def prefix(rows: DataFrame, key: str, grams: str, size: str) -> DataFrame:
        each = rows.select(key, F.size(grams).alias(size), F.explode(grams).alias("gram")).join(held, "gram", "left")
        ordered = each.groupBy(key, size).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
        kept = F.slice("g", F.lit(1), (F.col(size) - F.ceil(F.col(size) * least - 1e-9) + 1).cast("int"))
        return ordered.filter(F.col(size) > 0).select(key, size, F.explode(kept).alias("k")).select(key, size, "k.gram")
    met = prefix(n, "name", "b", "nb").join(prefix(q, "query", "a", "na"), "gram").filter(F.least("na", "nb") >= F.greatest("na", "nb") * least)
    pairs = met.select("query", "name").distinct().join(q, "query").join(n, "name")
    shared = F.size(F.array_intersect("a", "b"))
    s = pairs.select("query", "name", (shared / (F.size("a") + F.size("b") - shared)).alias("similarity"))
    return s.filter(F.col("similarity") >= least)


#: Queries per block.
QUERY_BLOCK = 2_000


def _block_nearest(k: int):
    """The k nearest rows of a batch for each query of a block, by matrix product in double precision."""
    def run(table: pa.Table) -> pa.Table:
        is_q = table.column("is_query").to_numpy(zero_copy_only=False)
        ids, vec = table.column("id").combine_chunks(), table.column("vec").combine_chunks()
        qi, ri = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        out_q, out_r, out_c = [], [], []
        if len(qi) and len(ri):
            size = np.asarray(pc.list_value_length(vec))
            for d in np.unique(size[qi]):
                a, b = qi[size[qi] == d], ri[size[ri] == d]
                if not d or not len(b):
                    continue
                x, y = (np.asarray(vec.take(pa.array(r)).flatten().fill_null(np.nan), np.float64).reshape(len(r), d) for r in (a, b))
                with np.errstate(invalid="ignore", divide="ignore"):
                    cos = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
                cos[np.asarray(ids.take(pa.array(a)))[:, None] == np.asarray(ids.take(pa.array(b)))[None, :]] = np.nan
                key = np.where(np.isfinite(cos), np.round(cos, 9), -np.inf)
                # all that tie with the k-th stay; they are ranked by id once all pieces have come together
                floor = np.partition(key, max(0, len(b) - k), axis=1)[:, max(0, len(b) - k)]
                rows, cols = np.nonzero((key >= floor[:, None]) & np.isfinite(cos))
                out_q.append(a[rows])
                out_r.append(b[cols])
                out_c.append(cos[rows, cols])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": ids.take(pa.array(cat(out_q, np.int64))), "id": ids.take(pa.array(cat(out_r, np.int64))), "cosine": pa.array(cat(out_c, np.float64))})
    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, piece_rows: int = 50_000) -> DataFrame:
    """(query_id, id, cosine, rank): exact nearest vectors to a stated query set (id, vec). Queries go in blocks and rows in pieces, by
    hash; each block meets each piece in a task of its own, which keeps its k best, so no task holds more than one of each."""
    nq, nr = queries.count(), rows.count()
    blocks, pieces = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nr // piece_rows))
    q = queries.select("id", "vec", F.lit(True).alias("is_query"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
    r = rows.select("id", "vec", F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(pieces)).cast("int").alias("piece"))
    kind = rows.schema["id"].dataType.simpleString()
    best = q.unionByName(r).groupBy("block", "piece").applyInArrow(_block_nearest(k), f"query_id {kind}, id {kind}, cosine double")
    return top(best, ["query_id"], [F.desc(F.round("cosine", 9)), F.col("id")], k)


def fuse(ranked: DataFrame, query: str, key: str, k: int = V.RRF_K, scale: float = V.RRF_SCALE) -> DataFrame:
    """Reciprocal rank fusion of rows (query, key, source, rank): score, and which source found it at which rank."""
    return ranked.groupBy(query, key).agg(
        (F.sum(1.0 / (F.lit(k) + F.col("rank"))) * scale).alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws("#", "source", "rank"))), ",").alias("found_by"))


def boosts(weights: dict[str, float] = V.BOOSTS) -> tuple[Column, Column]:
    """(sum of boosts, reasons) for rows with the flags exact, imported, called, same_dir, tests and the columns symbol,
    symbol_type and token_count."""
    generic = (F.col("token_count") < V.GENERIC_TOKENS) | F.coalesce(F.col("symbol").isin(V.GENERIC_SYMBOLS), F.lit(False))
    rules = [("exact_symbol", F.col("exact"), weights["exact_name"]), ("imported_module", F.col("imported"), weights["import_edge"]),
             ("called_by_change", F.col("called"), weights["called_edge"]), ("same_dir", F.col("same_dir"), weights["same_dir"]),
             ("tests_changed_symbol", F.col("tests"), weights["test_relation"]), ("module_section", (F.col("symbol_type") == "module") & ~F.col("exact"), weights["module_penalty"]),
             ("generic", generic, weights["generic_penalty"])]
    total = F.lit(0.0)
    for _, c, w in rules:
        total = total + F.when(c, w).otherwise(0.0)
    return total, F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c, _ in rules])), ",")


def import_targets(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(repository_id, import, path, symbol): the file of the longest module prefix of each dotted import that exists, the
    source roots in their order, a module before a package."""
    parts = F.split("import", r"\.")
    each = imports.select("repository_id", "import", F.explode(F.sequence(F.size(parts), F.lit(1), F.lit(-1))).alias("n")).withColumn("parts", F.split("import", r"\."))
    module = F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/")
    forms = [F.struct(F.lit(i).alias("o"), F.concat(F.lit(r), module, F.lit(e)).alias("path"))
             for i, (r, e) in enumerate((r, e) for r in V.SOURCE_ROOTS for e in (".py", "/__init__.py"))]
    cand = each.select("repository_id", "import", "n", F.array_join(F.slice("parts", F.col("n") + 1, F.size("parts")), ".").alias("symbol"), F.explode(F.array(*forms)).alias("c"))
    hit = cand.select("repository_id", "import", "n", "symbol", "c.o", "c.path").join(paths, ["repository_id", "path"])
    best = hit.groupBy("repository_id", "import").agg(F.min(F.struct(-F.col("n"), "o", "path", "symbol")).alias("m"))
    return best.select("repository_id", "import", "m.path", "m.symbol")
