"""Queries of the operators of this subpackage and their DuckDB texts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import prepare

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries():
    from . import queries as _q  # noqa: F401 - importing registers
    return dict(_QUERIES)


def oracle_sql():
    from . import queries as _q  # noqa: F401
    return dict(_SQL)
