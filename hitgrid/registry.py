"""All queries of the library by name, with the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "agg_feynman_y"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules of hitgrid.plans that register queries.
PLANS = ("moments", "channels", "windows", "joins", "scoring", "calibration", "reports", "ingest", "controllers", "learning")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its DuckDB twin where SQL can express it."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in PLANS:
        importlib.import_module(f"hitgrid.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
