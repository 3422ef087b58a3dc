"""Registered queries over the driver's tables, each with DuckDB SQL for the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """t.events is the table `events` of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)

    def path(self, name: str) -> str:
        """Where a table is, for streams; with a pattern a table may be a file or a folder."""
        return f"{self._dir}/{name}.parquet"

    @property
    def spark(self) -> SparkSession:
        return self._spark


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from . import domain, relational, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["j07_d13_numeric_contradictions"](spark, sf_dir)
