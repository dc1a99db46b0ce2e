"""Registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from . import aggregates, charging, forecasts, models, scores, sources  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
