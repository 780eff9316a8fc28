"""Registry of named queries: Spark callable + optional DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def with_ctes(*ctes: tuple[str, str]) -> str:
    """``WITH a AS (...), b AS (...)`` from (name, body) pairs, duplicates dropped."""
    seen, parts = set(), []
    for name, body in ctes:
        if name in seen:
            continue
        seen.add(name)
        parts.append(f"{name} AS (\n{body.strip()}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
