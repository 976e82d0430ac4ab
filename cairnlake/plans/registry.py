"""All core queries and their SQL."""

from __future__ import annotations

from cairnlake.plans import chunk_queries, context_queries, event_queries, fold_queries, hybrid_queries, index_queries, problem_queries, relational_queries, review_queries, search_queries, text_queries

MODULES = (problem_queries, text_queries, index_queries, search_queries, fold_queries, event_queries, chunk_queries, context_queries, relational_queries, review_queries, hybrid_queries)
FLAGSHIP = search_queries.h1_lexical_topk


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
