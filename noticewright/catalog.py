"""Registry of the library's queries and of the SQL that they are checked against."""

from __future__ import annotations

from .sources import html, tables, versions  # noqa: F401
from .streaming import incremental, reminders  # noqa: F401
from .operators import aggregates, blocks, classification, cycles, deadlines, extraction, filters, joins, messages, organizers, ranking, scalars, variants  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark, sf_dir: str):
    return QUERIES["D14_keyword_search"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
