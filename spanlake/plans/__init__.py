"""Every operator as a query over the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _parts():
    from spanlake.plans import annotation, filters, joins, metadata, readers, statistics, studies

    return readers, filters, metadata, annotation, statistics, joins, studies


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _parts() for name, query in part.register.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.register.sql.items()}
