"""Queries by name, each with the SQL another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), ctes: str = "") -> Callable:
    """Register a query; `uses` names fixture views that the SQL reads, `ctes` adds more."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            views = ", ".join([f"{v} AS ({SQL[v]})" for v in uses] + ([ctes] if ctes else []))
            ORACLES[name] = (f"WITH RECURSIVE {views} " if views else "") + sql
        return f

    return wrap


def r(expression: str, digits: int = 6) -> str:
    """SQL of functions.base.rounded."""
    return f"FLOOR(({expression}) * 1e{digits} + 0.5) / 1e{digits}"
