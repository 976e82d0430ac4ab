"""All queries of this subpackage and their SQL; the modules hold both."""

from __future__ import annotations

from cairnlake.llm import credential_queries, generated_queries, leakage_queries, packing_queries, quality_queries, similar_queries, split_queries, syntax_queries

MODULES = (credential_queries, generated_queries, leakage_queries, packing_queries, quality_queries, similar_queries, split_queries, syntax_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
