"""All queries of the core."""

from __future__ import annotations

from . import queries as project
from . import cache_queries, extraction_queries, metrics_queries, plan_queries, retrieval_queries, text_queries

PARTS = (project, text_queries, extraction_queries, retrieval_queries, cache_queries, plan_queries, metrics_queries)


def queries() -> dict[str, project.Query]:
    return {k: q for part in PARTS for k, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in PARTS for k, q in part.SQL.items()}
