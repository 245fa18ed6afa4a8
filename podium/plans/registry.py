"""All queries of the library and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules whose queries are registered.
MODULES = ("relational", "aggregates", "windows", "scalars", "documents", "changes", "resolution", "extraction", "streams", "commits", "merges", "nested", "sections", "headers")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_rows: dict[str, str] = {}


def query(rows: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; rows: the operators of the survey that it shows."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"{f.__name__} is registered twice")
        _queries[f.__name__] = f
        _rows[f.__name__] = rows
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"podium.plans.{name}")


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_sql)


def survey_rows() -> dict[str, str]:
    load()
    return dict(_rows)
