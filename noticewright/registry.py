"""Queries by name, each with the SQL that it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under the survey id that ``name`` starts with."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
