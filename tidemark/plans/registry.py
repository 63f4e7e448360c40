"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register ``fn(spark, dir)`` under ``name`` with its check SQL."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: dates as text, whole numbers as bigint, doubles rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType,)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)
