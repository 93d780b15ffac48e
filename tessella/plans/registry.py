"""Registered queries: a Spark plan over the given tables and, where SQL can say it, its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named SQL block that queries and other views may read."""
    VIEWS[name] = sql


def variant(prefix: str, bases: dict[str, str], targets: list[str]) -> None:
    """Copies of the views that ``targets`` need and that rest on ``bases``, over other SQL for these, with prefixed names."""
    needed, todo = set(targets), list(targets)
    while todo:
        for v in _needs(VIEWS[todo.pop()]):
            if v not in needed:
                needed.add(v)
                todo.append(v)
    wanted = set(bases)
    for name in VIEWS:
        if name in needed and wanted & set(_needs(VIEWS[name])):
            wanted.add(name)
    names = re.compile(r"(?<![.\w'])(" + "|".join(sorted(wanted, key=len, reverse=True)) + r")(?![\w'])")
    for name in [n for n in VIEWS if n in wanted]:
        view(f"{prefix}{name}", bases.get(name) or names.sub(rf"{prefix}\1", VIEWS[name]))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", sql))
    return [v for v in VIEWS if v in words]


def full_sql(name: str) -> str:
    """The query with the views it needs, in order of definition, as common table expressions."""
    wanted: set[str] = set()
    todo = [SQL[name]]
    while todo:
        for v in _needs(todo.pop()):
            if v not in wanted:
                wanted.add(v)
                todo.append(VIEWS[v])
    ctes = ",\n".join(
        f"{v} as {'materialized ' if 'recursive' not in VIEWS[v] else ''}({VIEWS[v]})" for v in VIEWS if v in wanted
    )
    return f"with recursive {ctes}\n{SQL[name]}" if ctes else SQL[name]
