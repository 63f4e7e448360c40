"""Forecast evaluation: metrics, slices, calibration, seasonality, multiplicity, sequential tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import VARIANCE_FLOOR, floored, qlike, with_scalars

WINDOWS_PER_YEAR = 252.0 * 13.0


def forecast_metrics(df: DataFrame, keys: list[str], actual: str, forecast: str) -> DataFrame:
    err = F.col(forecast) - F.col(actual)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(qlike(F.col(actual), F.col(forecast))).alias("qlike"),
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))


def session_differences(df: DataFrame, keys: list[str], value: str, day: str = "session_date") -> DataFrame:
    """One mean per session, sessions weighted equally afterwards."""
    return df.groupBy(*keys, day).agg(F.avg(value).alias("value"), F.count(value).alias("origins"))


def slice_summary(df: DataFrame, value: str, slices: dict[str, Column]) -> DataFrame:
    """Per slice group: mean and leave-one-group-out mean beside the slice's diagnostics."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("group")) for n, c in slices.items()]))
    g = df.select(pairs.alias("_p"), F.col(value).alias("_x")).select("_p.*", "_x").groupBy("slice", "group").agg(
        F.sum("_x").alias("s"), F.count("_x").alias("n"))
    w = Window.partitionBy("slice")
    tot, cnt = F.sum("s").over(w), F.sum("n").over(w)
    g = g.withColumns({
        "mean": F.col("s") / F.col("n"), "overall": tot / cnt,
        "leave_out": F.when(cnt > F.col("n"), (tot - F.col("s")) / (cnt - F.col("n"))),
        "groups": F.count(F.lit(1)).over(w), "dominance": F.max(F.abs("s")).over(w) / F.sum(F.abs("s")).over(w)})
    flips = (F.col("leave_out").isNotNull() & (F.signum("leave_out") != F.signum("overall")) & (F.col("overall") != 0)).cast("bigint")
    return g.withColumns({
        "positive_groups": F.sum((F.col("mean") > 0).cast("bigint")).over(w), "flips": F.sum(flips).over(w)}).drop("s")


def seasonality_index(df: DataFrame, bucket: str, value: str, training: str) -> DataFrame:
    """Training mean per bucket minus the training mean; an unseen bucket reads zero."""
    train = df.where(F.col(training))
    per = train.groupBy(bucket).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    whole = per.agg((F.sum("_s") / F.sum("_n")).alias("_g"))
    index = with_scalars(per, whole).select(
        bucket, (F.col("_s") / F.col("_n") - F.col("_g")).alias("seasonality"))
    return df.join(index, bucket, "left").withColumn("seasonality", F.coalesce("seasonality", F.lit(0.0)))


def pivot_losses(df: DataFrame, models: list[str], day: str = "session_date") -> DataFrame:
    """Session x model matrix of mean losses, complete sessions only."""
    wide = df.groupBy(day).pivot("model", models).agg(F.avg("loss"))
    return wide.dropna(subset=models)


def regime_summary(df: DataFrame, keys: list[str], day: str, index: str, target: str) -> DataFrame:
    """Daily index median, p90 and maximum, mean daily target and the session span per key."""
    daily = df.groupBy(*keys, day).agg(F.avg(index).alias("_i"), F.avg(target).alias("_t"))
    return daily.groupBy(*keys).agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("sessions"),
        F.percentile("_i", F.lit(0.5)).alias("index_median"), F.percentile("_i", F.lit(0.9)).alias("index_p90"),
        F.max("_i").alias("index_max"), F.avg("_t").alias("mean_daily_target"))


def leave_ranges_out(daily: DataFrame, ranges: list[tuple[str, str]], day: str = "session_date") -> DataFrame:
    """Drop sessions inside any declared date range."""
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return daily.where(~inside)


def annualised_errors(df: DataFrame, keys: list[str], actual: str, forecast: str) -> DataFrame:
    def vol(c: str) -> Column:
        return F.sqrt(F.col(c) * WINDOWS_PER_YEAR)

    e = vol(forecast) - vol(actual)
    return df.groupBy(*keys).agg(
        (F.sqrt(F.avg(e * e)) * 100.0).alias("vol_rmse_points"), (F.avg(F.abs(e)) * 100.0).alias("vol_mae_points"),
        F.avg(F.abs(F.col(forecast) - F.col(actual))).alias("cost_per_window"))


def metric_drift(metrics: DataFrame, keys: list[str], block: str, blocks: tuple[str, str], values: list[str]) -> DataFrame:
    """Second block minus first block of each metric."""
    def at(v: str, b: str) -> Column:
        return F.max(F.when(F.col(block) == b, F.col(v)))

    return metrics.groupBy(*keys).agg(*[(at(v, blocks[1]) - at(v, blocks[0])).alias(f"{v}_drift") for v in values])


def mincer_zarnowitz(df: DataFrame, keys: list[str], actual: str, forecast: str) -> DataFrame:
    """ln actual on ln forecast: intercept, slope, R2, residual variance and joint Wald for (0, 1)."""
    y, x = F.log(floored(actual, VARIANCE_FLOOR)), F.log(floored(forecast, VARIANCE_FLOOR))
    m = df.select(*keys, y.alias("_y"), x.alias("_x")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r_squared"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"), F.avg("_x").alias("_mx"))
    sse = F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")
    m = m.withColumn("sigma2", sse / (F.col("n") - 2))
    # The information matrix of (a, b) is X'X / sigma2, so the Wald form needs no inverse.
    a, b = F.col("intercept"), F.col("slope") - 1.0
    n, mx = F.col("n"), F.col("_mx")
    xx = F.col("_sxx") + n * mx * mx
    wald = (n * a * a + 2.0 * n * mx * a * b + xx * b * b) / F.col("sigma2")
    return m.withColumn("wald", wald).select(*keys, "n", "intercept", "slope", "r_squared", "sigma2", "wald")


def recalibrate(forecast: Column, intercept: Column, slope: Column, sigma2: Column) -> Column:
    """exp(a + b ln f + s2 / 2): the correction with the lognormal retransformation."""
    return F.exp(intercept + slope * F.log(forecast) + sigma2 / 2.0)


def smearing_factor(residual: str | Column) -> Column:
    """Aggregate: exp of half the residual variance."""
    return F.exp(0.5 * F.var_pop(residual))


def holm(df: DataFrame, family: list[str], name: str, p: str) -> DataFrame:
    """Holm step-down adjusted p-values per family, ties by name."""
    w = Window.partitionBy(*family)
    o = w.orderBy(p, name)
    rank = F.row_number().over(o)
    step = df.withColumn("_raw", F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - rank + 1) * F.col(p)))
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("adjusted", F.max("_raw").over(upto)).drop("_raw")


def sequential_evidence(df: DataFrame, keys: list[str], order: str, log_e: str, alpha: float) -> DataFrame:
    """Spending schedule a/(k(k+1)), running evidence and the always-valid p-value at each look."""
    o = Window.partitionBy(*keys).orderBy(order)
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    k = F.row_number().over(o)
    run = df.withColumn("k", k).withColumn("alpha_k", F.lit(alpha) / (F.col("k") * (F.col("k") + 1))).withColumn(
        "log_martingale", F.sum(log_e).over(upto))
    return run.withColumn("always_valid_p", F.least(F.lit(1.0), F.exp(-F.max("log_martingale").over(upto))))
