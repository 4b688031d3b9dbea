"""All registered queries."""

from __future__ import annotations

from paperloom.queries import builds, chunking, documents, events, feed, models, searching, tables
from paperloom.queries.base import ORACLE, QUERIES, Query

__all__ = ["builds", "chunking", "documents", "events", "feed", "models", "searching", "tables", "oracle_sql", "queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
