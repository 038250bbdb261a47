"""The query catalog: every query's name, its DataFrame plan, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan under its own name, with the equivalent SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


for _module in ("bars", "rolling", "xsection", "temporal", "ledger", "scoring", "relational", "text", "panels", "rules", "parsers", "decisions", "estimators", "providers", "drivers", "regime", "walks", "streams", "selection", "riskpanels"):
    import_module(f"{__package__}.{_module}")
