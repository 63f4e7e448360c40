"""Session calendars, origin grids and dense bar grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, MICROS, date_micros

MINUTE_US = 60 * MICROS


def session_calendar(
    days: DataFrame,
    holiday: Column,
    early: Column,
    open_minute: int = 0,
    full_minutes: int = 1440,
    early_minutes: int = 720,
) -> DataFrame:
    """One row per calendar date between the first and last date of ``days``.

    A holiday has length zero; it is not a session.  ``holiday`` and ``early`` are predicates
    on ``session_date``.
    """
    length = F.when(holiday, 0).when(early, early_minutes).otherwise(full_minutes).cast("bigint")
    return (
        days.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
        .select(F.explode(F.sequence("a", "b")).alias("session_date"))
        .withColumn("minutes", length)
        .withColumn("open_us", date_micros("session_date") + F.lit(open_minute * MINUTE_US))
        .withColumn("close_us", F.col("open_us") + F.col("minutes") * F.lit(MINUTE_US))
        .withColumn("is_early", (F.col("minutes") > 0) & (F.col("minutes") < full_minutes))
    )


def origin_grid(
    calendar: DataFrame,
    assets: list[str],
    first: int,
    before_close: int,
    step: int,
    inclusive: bool = True,
) -> DataFrame:
    """Forecast origins open+first .. close-before_close per asset, from the session length."""
    last = F.col("minutes") - F.lit(before_close) - (0 if inclusive else 1)
    return (
        calendar.where((F.col("minutes") > 0) & (last >= first))
        .withColumn("minute", F.explode(F.sequence(F.lit(first).cast("bigint"), last, F.lit(step).cast("bigint"))))
        .withColumn("asset", F.explode(F.array(*[F.lit(a) for a in assets])))
        .select(
            "asset",
            "session_date",
            "minute",
            (F.col("open_us") + F.col("minute") * F.lit(MINUTE_US)).alias("origin_us"),
        )
        .withColumn("origin_id", F.concat_ws(":", "asset", F.col("origin_us").cast("string")))
    )


def dense_grid(
    bars: DataFrame, calendar: DataFrame, assets: list[str], bar_minutes: int = 1
) -> DataFrame:
    """Every bar slot of every session; price carried forward only, never backward.

    ``bars`` carries asset, session_date, bar and OHLCV.  Leading slots stay null and
    ``valid`` is false there; the open is never filled; a missing volume is zero.
    """
    slots = (
        calendar.where(F.col("minutes") >= bar_minutes)
        .withColumn("slots", F.floor(F.col("minutes") / bar_minutes).cast("bigint"))
        .withColumn("bar", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)))
        .withColumn("asset", F.explode(F.array(*[F.lit(a) for a in assets])))
        .select("asset", "session_date", "bar", "slots", "open_us")
    )
    w = Window.partitionBy("asset", "session_date")
    upto = w.orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    joined = slots.join(
        bars.select("asset", "session_date", "bar", "open", "high", "low", "close", "volume"),
        ["asset", "session_date", "bar"],
        "left",
    )
    return (
        joined.withColumn("observed", F.col("close").isNotNull())
        .withColumn("close", F.last("close", ignorenulls=True).over(upto))
        .withColumn("valid", F.col("close").isNotNull())
        .withColumn("high", F.coalesce("high", "close"))
        .withColumn("low", F.coalesce("low", "close"))
        .withColumn("volume", F.coalesce("volume", F.lit(0.0)))
        .withColumn("fill_share", F.avg(F.when(F.col("observed"), 0.0).otherwise(1.0)).over(w))
    )


def make_bars(ticks: DataFrame, bar_minutes: int = 1) -> DataFrame:
    """OHLCV bars of a price tape: asset, session_date, minute_us offset, price, size, id."""
    order = F.struct("executed_us", "id")
    width = bar_minutes * MINUTE_US
    return (
        ticks.withColumn("bar", F.floor(F.pmod(F.col("executed_us"), F.lit(DAY_US)) / width).cast("bigint"))
        .groupBy("asset", "session_date", "bar")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").cast("double").alias("volume"),
        )
    )
