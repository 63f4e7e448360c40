"""Scalar column expressions: rounding, time keys, direction tags, transforms, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000
VARIANCE_FLOOR = 1e-12
DAY_US = 86_400 * MICROS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as one scalar subquery."""
    packed = one.select(F.struct(*one.columns).alias("_s")).scalar()
    return df.withColumn("_scalars", packed).select("*", "_scalars.*").drop("_scalars")


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round for comparison and turn a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """Null for NaN and infinities: producers of this library emit null only."""
    x = col(c)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def floored(c: str | Column, floor: float) -> Column:
    """The value, not less than ``floor``; null stays null (``greatest`` would skip it)."""
    x = col(c)
    return F.when(x < floor, F.lit(float(floor))).otherwise(x)


def ntz_micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col(c))


def date_micros(c: str | Column) -> Column:
    return F.datediff(col(c), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(DAY_US)


def floor_div(c: Column, step: int) -> Column:
    """Floor division of a bigint by a positive step; exact below 2**53 steps."""
    s = F.lit(step).cast("bigint")
    return ((c - F.pmod(c, s)) / s).cast("bigint")


def ceil_div(c: Column, step: int) -> Column:
    s = F.lit(step).cast("bigint")
    return ((c + F.pmod(-c, s)) / s).cast("bigint")


def contract_key(expiry: Column, strike: Column, is_call: Column) -> Column:
    """Expiry day, strike in thousandths and side packed in one bigint."""
    day = F.datediff(expiry, F.lit("1970-01-01").cast("date")).cast("bigint")
    return (
        day * F.lit(20_000_000)
        + F.round(strike * 1000.0).cast("bigint") * 2
        + is_call.cast("bigint")
    )


def trade_direction(tags: Column, multileg: Column | None = None) -> Column:
    """+1 for a buyer-initiated tag, -1 for a seller-initiated one, 0 otherwise or multi-leg."""
    sign = (
        F.when(F.coalesce(tags, F.lit("")).contains("ask_side"), 1.0)
        .when(F.coalesce(tags, F.lit("")).contains("bid_side"), -1.0)
        .otherwise(0.0)
    )
    return sign if multileg is None else F.when(multileg, F.lit(0.0)).otherwise(sign)


def latency_seconds(created_us: Column, executed_us: Column) -> Column:
    return (created_us - executed_us) / F.lit(float(MICROS))


def transform(c: str | Column, kind: str) -> Column:
    """The registered column transforms: log, signed_log or raw."""
    x = col(c)
    if kind == "log":
        return F.log(floored(x, VARIANCE_FLOOR))
    if kind == "signed_log":
        return F.signum(x) * F.log1p(F.abs(x))
    if kind == "raw":
        return x
    raise ValueError(f"unknown transform: {kind}")


def qlike(actual: Column, forecast: Column, floor: float = VARIANCE_FLOOR) -> Column:
    """a/f - ln(a/f) - 1 with a floored forecast; null unless the target is positive."""
    ratio = actual / floored(forecast, floor)
    return F.when(actual > 0, ratio - F.log(ratio) - 1.0)


def qlike_gradient(actual: Column, log_forecast: Column, clip: float = 30.0) -> Column:
    return 1.0 - qlike_hessian(actual, log_forecast, clip)


def qlike_hessian(actual: Column, log_forecast: Column, clip: float = 30.0) -> Column:
    z = F.when(log_forecast > clip, clip).when(log_forecast < -clip, -clip).otherwise(log_forecast)
    return actual * F.exp(-z)


def forward_variance(w1: Column, t1: Column, w2: Column, t2: Column) -> Column:
    f = (w2 - w1) / (t2 - t1)
    return F.when((t2 > t1) & (f > 0), f)


def annualise(variance: Column, minutes: float = 30.0) -> Column:
    """Per-window variance to annual variance, 252 sessions of 390 minutes."""
    return F.when(variance >= 0, variance * F.lit(252.0 * 390.0 / minutes))
