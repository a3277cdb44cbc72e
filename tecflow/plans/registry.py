"""Named queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("series_queries", "geometry_queries", "aggregate_queries", "join_queries", "grouped_queries", "index_queries", "result_queries", "positioning_queries", "broadcast_queries", "troposphere_queries", "orientation_queries")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"query {f.__name__} is registered twice")
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded, with minus zero as zero, so that both engines print the same value."""
    return (F.round(column, digits) + 0.0).alias(name)


def loaded() -> None:
    for m in MODULES:
        import_module(f"tecflow.plans.{m}")


def queries() -> dict[str, Query]:
    loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    loaded()
    return dict(_SQL)
