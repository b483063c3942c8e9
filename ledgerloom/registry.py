"""Where operators register the queries that exercise them, each with the SQL that checks its rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("ledgerloom.plans.catalog_scalar", "ledgerloom.plans.catalog_relational", "ledgerloom.plans.catalog_composite")
FLAGSHIP = "agg_01_activity_pulse"

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame; ``sql`` gives the same rows in DuckDB."""

    def put(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
