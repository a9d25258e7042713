"""Queries over the driver's tables, one for each operator, and SQL that says the same."""

from __future__ import annotations

from . import queries_scalar, queries_series, queries_space, queries_tables
from .fixtures import ORACLES, QUERIES, Query

__all__ = ["oracle_sql", "queries", "queries_scalar", "queries_series", "queries_space", "queries_tables"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
