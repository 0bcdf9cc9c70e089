"""Registry of named queries with the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("q_features", "q_signals", "q_rotation", "q_regimes", "q_universe", "q_performance",
            "q_portfolio", "q_validation", "q_tables")



def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its counterpart for the comparison run."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def load() -> None:
    """Import every query module once."""
    for m in _MODULES:
        import_module(f"barloom.plans.{m}")
