"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlake.plans.views import Views, with_views


class Register:
    """As a decorator with SQL (over the tables and views) on a function of the views; without SQL the query has no oracle."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable[[Views], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql is not None:
                self.sql[f.__name__] = with_views(sql)
            return f

        return add
