"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.tables import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query.  ``views`` lists the derived views the SQL twin reads."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = build
        if sql is not None:
            _SQL[name] = with_views(views.split(), sql)
        return build

    return wrap


def load_all() -> None:
    from workload import (  # noqa: F401
        annotations, augmenting, cleanup, editing, features, files, lineage, listings, models,
        regions, relations, scalars, schemas, statistics, streams,
    )


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return {
        name: (lambda spark, sf_dir, _build=build: _build(Tables(spark, sf_dir)))
        for name, build in _QUERIES.items()
    }


def sql_twins() -> dict[str, str]:
    load_all()
    return dict(_SQL)
