"""Every registered query with its SQL twin. A query module holds QUERIES and ORACLE."""

from __future__ import annotations


def _modules() -> list:
    from . import corpus_queries, geometry_queries, text_queries

    return [text_queries, corpus_queries, geometry_queries]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
