"""How a query is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(queries: dict[str, Query], sqls: dict[str, str], sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        queries[f.__name__] = f
        if sql:
            sqls[f.__name__] = sql
        return f

    return add
