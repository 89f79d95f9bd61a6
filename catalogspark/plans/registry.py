"""Register of queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}

_VIEW_NAME = re.compile(r"\bv_\w+")


def view(name: str, sql: str) -> None:
    """A named subquery that oracles and later views may use."""
    VIEWS[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named views."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def expand(sql: str) -> str:
    """Put the definitions of all used views in front of a statement."""
    ordered: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(_VIEW_NAME.findall(text)):
            if name in VIEWS and name not in entered:
                entered.add(name)
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    definitions = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body, opening = sql.strip(), "WITH RECURSIVE"
    if body.startswith(opening):
        return f"{opening} {definitions},\n{body[len(opening):]}"
    return f"{opening} {definitions}\n{body}"
