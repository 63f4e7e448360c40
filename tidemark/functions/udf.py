"""The Python function surface: a grouped map and a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


def grouped_producer(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A per-(session, asset) Python producer on bar-grain input.

    The native operators come first; this is for measures they do not express.  The group must
    be bounded: bars of one session, not trades.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


@udtf(returnType="minute bigint, origin_us bigint", useArrow=True)
class SessionOrigins:
    """Origins of one session: origins(open_us, minutes, first, before_close, step)."""

    def eval(self, open_us: int, minutes: int, first: int, before_close: int, step: int) -> Iterator[tuple[int, int]]:
        if minutes:
            for m in range(first, minutes - before_close + 1, step):
                yield m, open_us + m * 60_000_000


def register(spark: SparkSession) -> None:
    """Make ``session_origins`` callable from SQL with LATERAL."""
    spark.udtf.register("session_origins", SessionOrigins)
