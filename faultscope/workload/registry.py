"""Registered queries: each a Spark job over the given tables, most with the SQL
that DuckDB must agree with."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_map(data: Column | str) -> Column:
    """A payload as one text, ``key=value`` in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(data)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
