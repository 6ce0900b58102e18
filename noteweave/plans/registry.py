"""All queries of the core, and of the llm subpackage where it is installed."""

from __future__ import annotations

from noteweave.plans import catalogue_queries, context_queries, note_queries, problems, retrieval_queries, rule_queries, store_queries, term_queries

MODULES = [problems, catalogue_queries, retrieval_queries, note_queries, store_queries, term_queries, context_queries, rule_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.sql().items()}
