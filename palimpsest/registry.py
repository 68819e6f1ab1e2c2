"""Registry of the change-analytics queries."""

from __future__ import annotations

from .plans import accounts, delta, matching, notices, packages, places, record, tables, texts, twins, upkeep, watch

MODULES = (delta, record, matching, watch, texts, upkeep, places, tables, accounts, twins, packages, notices)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
