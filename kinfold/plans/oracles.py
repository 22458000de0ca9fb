"""SQL the core queries are compared with."""

from __future__ import annotations

from . import detail_queries, review_queries, scan_queries


def oracle_sql() -> dict[str, str]:
    return scan_queries.SQL | review_queries.SQL | detail_queries.SQL
