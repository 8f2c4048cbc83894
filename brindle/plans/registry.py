"""All queries of the library and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import series_queries, text_queries


def queries() -> dict:
    return text_queries.Q | series_queries.Q


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | series_queries.SQL
