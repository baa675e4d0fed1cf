"""All queries of the core library and the SQL they are checked against."""

from __future__ import annotations

from . import context, filings, loads, problems

MODULES = (filings, loads, context, problems)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
