"""All queries by name, and the SQL that says the same."""

from __future__ import annotations

from spindrift.plans import board_queries, resolve_queries, state_queries, text_queries  # noqa: F401
from spindrift.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
