"""Registration of queries: a function (spark, sf_dir) -> DataFrame with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
