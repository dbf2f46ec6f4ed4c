"""Registry of the queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from docframe.plans import reference_sql as ref

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the shared table expressions its SQL needs."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            body = dedent(sql).strip()
            ctes = ref.expand(uses.split())
            if ctes:
                joiner = ",\n" if body.upper().startswith("WITH ") else "\n"
                body = ctes + joiner + (body[5:] if joiner == ",\n" else body)
            ORACLES[name] = body
        return fn

    return add
