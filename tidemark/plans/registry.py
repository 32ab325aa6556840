"""The table of queries of a module."""

from __future__ import annotations


def registry():
    """Queries by name, their SQL, and the decorator that enters both."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
