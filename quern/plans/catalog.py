"""The registered queries of the knowledge-base operators and their SQL equivalents."""

from __future__ import annotations

from quern.plans import answer_queries, base_queries, retrieval_queries, source_queries
from quern.plans.registry import QUERIES, SQL

FLAGSHIP = "hybrid_retrieve"
_MODULES = (base_queries, retrieval_queries, answer_queries, source_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
