"""The list of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
_MODULES: tuple[str, ...] = ("spatial", "scoring", "series", "search", "ingest", "routing", "terrain", "planning", "streams", "geometry", "facts", "trips", "hikes", "rings", "walks")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under a name, with its DuckDB equivalent if there is one."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return keep


def _load() -> None:
    from importlib import import_module

    for m in _MODULES:
        import_module(f"cairnpath.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLE
