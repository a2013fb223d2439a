"""The query registry: name -> (Spark callable, check SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strayfield.session import configure
from strayfield.sources.tables import Tables, with_views

Builder = Callable[[Tables], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; ``sql`` is the equivalent statement over the base tables, if one exists."""

    def register(build: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"duplicate query {name}")
        _BUILDERS[name] = build
        if sql is not None:
            _SQL[name] = with_views(sql)
        return build

    return register


def _runner(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Tables(configure(spark), folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import strayfield.plans.catalog  # noqa: F401  (fills the registry)

    return {name: _runner(build) for name, build in _BUILDERS.items()}


def all_sql() -> dict[str, str]:
    import strayfield.plans.catalog  # noqa: F401

    return dict(_SQL)
