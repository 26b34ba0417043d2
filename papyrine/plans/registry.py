"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table reader) under its name, with equivalent SQL where there is some."""

    def add(make):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return make(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        run.__doc__ = make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            SQL[make.__name__] = sql
        return make

    return add
