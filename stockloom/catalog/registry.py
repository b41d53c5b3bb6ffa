"""Named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stockloom.plans.tables import Tables
from stockloom.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(Tables(configure(spark), directory))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in plain SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register
