"""Queries are registered beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        if function.__name__ in QUERIES:
            raise ValueError(f"{function.__name__} is registered twice")
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.500123) / 1e6)"
