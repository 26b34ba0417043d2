"""All queries of the core library."""

from __future__ import annotations

from papyrine.plans import build_queries, data_queries, retrieval_queries, text_queries  # noqa: F401
from papyrine.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
