"""Queries of the core library and their DuckDB SQL."""

from __future__ import annotations

from .plans import designs, more  # noqa: F401  they register their queries
from .plans import queries as plans


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
