"""All registered queries with the SQL that states the same result."""

from __future__ import annotations

from . import bar_queries, breadth_queries, chain_queries, clock_queries, context_queries, file_queries, indicator_queries, inference_queries, live_queries, more_queries, review_queries, signal_queries, stats_queries, store_queries, stream_queries, study_queries  # noqa: F401
from .define import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
