"""Query registry: each catalogue query has a Spark builder and (usually) an
independent DuckDB oracle string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its oracle SQL (None = rows-only)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c: str | Column, alias: str | None = None, digits: int = 6) -> Column:
    """Round a double for the oracle comparison (both sides round alike)."""
    col = F.col(c) if isinstance(c, str) else c
    name = alias or (c if isinstance(c, str) else None)
    out = F.round(col, digits)
    return out.alias(name) if name else out


def q(name: str) -> Column:
    """Column reference that tolerates dots in the name."""
    return F.col(f"`{name}`")
