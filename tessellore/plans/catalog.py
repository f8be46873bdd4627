"""All queries of the core and their SQL."""

from __future__ import annotations

from tessellore.plans import document_queries, golden_queries, nested_queries, retrieval_queries

QUERIES = {**retrieval_queries.QUERIES, **document_queries.QUERIES, **golden_queries.QUERIES, **nested_queries.QUERIES}
ORACLE = {**retrieval_queries.ORACLE, **document_queries.ORACLE, **golden_queries.ORACLE, **nested_queries.ORACLE}
