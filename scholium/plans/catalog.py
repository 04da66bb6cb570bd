"""Named queries over the test tables, each with the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("graph_queries", "analytics_queries", "text_queries", "metric_queries", "resolve_queries", "state_queries", "source_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it."""

    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _ORACLES[name] = sql
        return function

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"scholium.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: top institutions of a venue."""
    return queries()["g06_top_institutions"](spark, sf_dir)
