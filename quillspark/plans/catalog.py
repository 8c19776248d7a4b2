"""Queries over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.shipping import shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(shipped(spark), sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
