"""Registry of queries over the driver tables and of their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query and, if SQL can express it, its DuckDB counterpart."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    """The modules register their queries when they are imported."""
    for module in ("raster_queries", "graph_queries", "metric_queries", "segment_queries"):
        importlib.import_module(f"basinflow.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Each is materialised as one table, so that what a reader puts around it can't change its joins' order."""
    _load()
    return {name: f"WITH result AS MATERIALIZED (\n{sql}\n) SELECT * FROM result" for name, sql in _ORACLES.items()}
