"""Registered queries over the given tables, each next to the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on first use: ``t.orders`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a key, with its check in SQL where there is one."""

    def keep(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
