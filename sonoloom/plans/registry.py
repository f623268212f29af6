"""Query registry: a name, a DataFrame plan over the tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonoloom.sources.tables import table


class Tables:
    """Tables of one folder, read when named: ``t.orders``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Register a function of :class:`Tables`; ``sql`` gives the same rows in DuckDB."""

        def deco(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is registered twice")
            self.queries[key] = lambda spark, root: f(Tables(spark, root))
            if sql:
                self.sql[key] = sql
            return f

        return deco
