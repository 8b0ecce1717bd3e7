"""Registered queries over the catalogue operators, with their DuckDB equivalents."""

from __future__ import annotations

from . import diagnosing, exploring, matching, recording, routing, texts  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
