"""Keyed session series: splits, drawdown, autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from .ordered import split_running_max, split_running_sum


def session_rank(df: DataFrame, day: str = "session_date") -> DataFrame:
    """Dense rank of each row's session from zero; only distinct sessions are ordered."""
    ranks = df.select(day).distinct().withColumn(
        "session_index", (F.row_number().over(Window.orderBy(day)) - 1).cast("bigint")
    )
    return df.join(ranks, day)


def chronological_split(df: DataFrame, train_share: float, day: str = "session_date") -> DataFrame:
    """First ``train_share`` of the sessions train, never part of a session."""
    if not 0 < train_share < 1:
        raise ValueError("train_share must lie inside (0, 1)")
    ranks = df.select(day).distinct().withColumn(
        "session_index", (F.row_number().over(Window.orderBy(day)) - 1).cast("bigint")
    )
    total = F.count(F.lit(1)).over(Window.partitionBy())
    cut = ranks.withColumn("is_train", F.col("session_index") < F.floor(total * F.lit(train_share)))
    return df.join(cut, day)


def session_series(df: DataFrame, keys: list[str], value: str, day: str = "session_date") -> DataFrame:
    """One mean per (series, session) and its position in the series, from zero."""
    means = df.groupBy(*keys, day).agg(F.avg(value).alias("value"), F.count(value).alias("origins"))
    w = Window.partitionBy(*keys).orderBy(day)
    return means.where(F.col("value").isNotNull()).withColumn(
        "idx", (F.row_number().over(w) - 1).cast("bigint")
    )


def one_session_lag(df: DataFrame, keys: list[str], values: list[str], day: str = "session_date") -> DataFrame:
    """The previous session's value at the same asset and minute; first sessions drop."""
    w = Window.partitionBy(*keys).orderBy(day)
    out = df.withColumns({v: F.lag(v).over(w) for v in values})
    for v in values:
        out = out.where(F.col(v).isNotNull())
    return out


def drawdown(series: DataFrame, keys: list[str], order: str, value: str, bucket: int = 65_536) -> DataFrame:
    """Equity as a running sum and its distance below the running maximum.

    ``order`` is a bigint, unique per key; a long series is cut into ranges of it.
    """
    cut = F.floor(F.col(order) / bucket)
    eq = split_running_sum(series, keys, [order], cut, F.col(value), "equity")
    top = split_running_max(eq, keys, [order], cut, F.col("equity"), "_top")
    return top.withColumn("drawdown", F.col("equity") - F.col("_top")).drop("_top")


def autocorrelation(series: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """Autocorrelations 1..max_lag and the Ljung-Box test per series."""
    w = Window.partitionBy(*keys)
    c = series.withColumn("_c", F.col("value") - F.avg("value").over(w))
    o = w.orderBy("idx")
    lags = range(1, max_lag + 1)
    c = c.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(o) for k in lags})
    out = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_d"),
        *[F.sum(f"_p{k}").alias(f"_s{k}") for k in lags],
    )
    out = out.withColumns({f"acf_{k}": F.col(f"_s{k}") / F.col("_d") for k in lags})
    total = sum((F.col(f"acf_{k}") ** 2 / (F.col("n") - k) for k in lags), F.lit(0.0))
    q = F.col("n") * (F.col("n") + 2.0) * total
    return out.withColumn("ljung_box", q).withColumn("p_value", chi2_sf(F.col("ljung_box"), max_lag)).select(
        *keys, "n", *[f"acf_{k}" for k in lags], "ljung_box", "p_value"
    )
