"""Strategy positions, portfolio caps, hedged P&L and performance, keyed by series."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import floored
from ..functions.special import normal_cdf
from .quantiles import group_quantiles
from .series import drawdown

MULTIPLIER = 100.0
EULER = 0.5772156649015329


def variance_position(implied: Column, forecast: Column, cost: Column, buffer: float) -> Column:
    """-1 short, +1 long, 0 flat: the premium must clear the cost and a buffer."""
    edge, bar = implied - forecast, cost + buffer
    return F.when(edge > bar, -1.0).when(edge < -bar, 1.0).otherwise(0.0)


def variance_pnl(position: Column, implied: Column, realized: Column, cost: Column) -> tuple[Column, Column]:
    gross = position * (realized - implied)
    return gross, gross - F.abs(position) * cost


def portfolio_caps(df: DataFrame, book: list[str], name: str, signal: str, max_gross: float, max_name: float) -> DataFrame:
    """Clip, scale each name to its cap, then scale the book to its gross cap."""
    c = F.when(F.col(signal) > max_name, max_name).when(F.col(signal) < -max_name, -max_name).otherwise(F.col(signal))
    clipped = df.withColumn("_c", c)
    per = clipped.groupBy(*book, name).agg(F.sum(F.abs("_c")).alias("_g")).withColumn(
        "_k", F.when(F.col("_g") > max_name, max_name / F.col("_g")).otherwise(1.0))
    total = per.groupBy(*book).agg(F.sum(F.col("_g") * F.col("_k")).alias("_t")).withColumn(
        "_b", F.when(F.col("_t") > max_gross, max_gross / F.col("_t")).otherwise(1.0))
    return clipped.join(per.drop("_g"), [*book, name]).join(total.drop("_t"), book).withColumn(
        "position", F.col("_c") * F.col("_k") * F.col("_b")).drop("_c", "_k", "_b")


def hedged_pnl(
    contracts: Column, entry_mid: Column, exit_mid: Column, entry_spot: Column, exit_spot: Column, entry_delta: Column,
    entry_half: Column, exit_half: Column, slippage: float, fee: float,
) -> dict[str, Column]:
    """Gross of option and entry-delta hedge, spread cost at both ends, fees and net."""
    gross = (contracts * (exit_mid - entry_mid) - contracts * entry_delta * (exit_spot - entry_spot)) * MULTIPLIER
    size = F.abs(contracts)
    spread = size * (entry_half + exit_half) * (1.0 + slippage) * MULTIPLIER
    fees = 2.0 * size * fee
    return {"gross_pnl": gross, "spread_cost": spread, "fees": fees, "net_pnl": gross - spread - fees}


def performance(df: DataFrame, keys: list[str], order: str, pnl: str, periods: float) -> DataFrame:
    """Mean, volatility, Sharpe, Sortino, hit rate, drawdown, shortfall, skewness and kurtosis."""
    x = F.col(pnl)
    down = F.when(x < 0, x)
    m = df.groupBy(*keys).agg(
        F.count(pnl).alias("periods"), F.avg(pnl).alias("mean"), F.stddev_samp(pnl).alias("volatility"),
        F.stddev_samp(down).alias("_down"), F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.skewness(pnl).alias("skewness"), (F.kurtosis(pnl) + 3.0).alias("kurtosis"))
    dd = drawdown(df.select(*keys, order, pnl), keys, order, pnl).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    cut = group_quantiles(df, keys, pnl, {"_q": 0.05})
    es = df.join(cut, keys).where(x <= F.col("_q")).groupBy(*keys).agg(F.avg(pnl).alias("shortfall_5pct"))
    root = math.sqrt(periods)
    return m.join(dd, keys).join(es, keys).withColumns({
        "sharpe": F.when(F.col("volatility") > 0, root * F.col("mean") / F.col("volatility")),
        "sortino": F.when(F.col("_down") > 0, root * F.col("mean") / F.col("_down"))}).drop("_down")


def deflated_sharpe(sharpe: Column, trials: int, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that a per-period Sharpe beats the best of ``trials`` under the null."""
    if trials < 2:
        raise ValueError("at least two trials")
    z = NormalDist()
    best = (1.0 - EULER) * z.inv_cdf(1.0 - 1.0 / trials) + EULER * z.inv_cdf(1.0 - 1.0 / (trials * math.e))
    den = F.sqrt(floored(1.0 - skew * sharpe + (kurt - 1.0) / 4.0 * sharpe * sharpe, 1e-12))
    return normal_cdf((sharpe - best) * F.sqrt(n - 1.0) / den)


def break_even_cost(gross: str, position: str) -> Column:
    """Aggregate: per-unit cost that consumes the gross P&L."""
    t = F.sum(F.abs(position))
    return F.when(t > 0, F.sum(gross) / t)


def risk_utility(df: DataFrame, keys: list[str], forecast: str, realized: str, ret: str, target: float,
                 level: float = 0.05, aversion: float = 2.0) -> DataFrame:
    """Vol-target tracking error, VaR breach rate, shortfall error and certainty equivalent."""
    z = NormalDist()
    q = z.inv_cdf(level)
    f = floored(forecast, 1e-16)
    w = F.sqrt(F.lit(target) / f)
    track = w * w * F.col(realized) / target - 1.0
    breach = F.col(ret) < q * F.sqrt(f)
    model = -F.sqrt(f) * z.pdf(q) / level
    port = w * F.col(ret)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(track * track)).alias("tracking_error"), F.avg(breach.cast("double")).alias("breach_rate"),
        F.abs(F.avg(F.when(breach, F.col(ret))) - F.avg(F.when(breach, model))).alias("shortfall_error"),
        (F.avg(port) - 0.5 * aversion * F.var_pop(port)).alias("certainty_equivalent"))

