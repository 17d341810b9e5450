"""Registry of named queries (one per operator of the survey inventory) and their DuckDB oracles."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load_all():
    # importing the modules registers their queries
    from . import (q_flagship, q_scans, q_clean, q_joins, q_profile, q_features, q_quality,  # noqa: F401
                   q_model, q_shape)


def _prepared(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import prepare_session
        return fn(prepare_session(spark), sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: _prepared(v) for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
