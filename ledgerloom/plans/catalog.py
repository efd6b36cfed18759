"""All queries and oracles of the ledger engine."""

from __future__ import annotations

from . import queries_access, queries_scalar, queries_state, queries_store, queries_tree, queries_workload  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
