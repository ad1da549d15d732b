"""Queries over the engine's operators and the SQL that checks them."""

from __future__ import annotations

from . import assembly_queries, outside_queries, record_queries, text_queries, web_queries

MODULES = (text_queries, web_queries, record_queries, assembly_queries, outside_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
