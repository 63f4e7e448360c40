"""Robust baselines of activity: prior-session deviation and frozen calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_of(sorted_array: Column, p: float) -> Column:
    """Linear quantile of an already sorted array column."""
    n = F.size(sorted_array)
    at = (n - 1) * F.lit(float(p))
    lo = F.floor(at).cast("int")
    a = F.try_element_at(sorted_array, lo + 1)
    b = F.try_element_at(sorted_array, F.least(lo + 2, n))
    return F.when(n > 0, a + (b - a) * (at - lo))


def _fit(df: DataFrame, values: str, prefix: str) -> DataFrame:
    """Median, and scale by MAD with the interquartile range behind it, of an array column."""
    s = F.sort_array(values)
    df = df.withColumn("_s", s).withColumn(f"{prefix}center", quantile_of(F.col("_s"), 0.5))
    dev = F.sort_array(F.transform("_s", lambda x: F.abs(x - F.col(f"{prefix}center"))))
    df = df.withColumn("_m", quantile_of(dev, 0.5)).withColumn(
        "_i", quantile_of(F.col("_s"), 0.75) - quantile_of(F.col("_s"), 0.25)
    )
    return df.withColumn(
        f"{prefix}scale",
        F.when(F.col("_m") > 0, 1.4826 * F.col("_m"))
        .when((F.size("_s") >= 2) & (F.col("_i") > 0), F.col("_i") / 1.349)
        .otherwise(0.0),
    ).withColumn(
        f"{prefix}label",
        F.when(F.col("_m") > 0, "MAD").when((F.size("_s") >= 2) & (F.col("_i") > 0), "IQR").otherwise("CONSTANT"),
    ).drop("_s", "_m", "_i")


def prior_session_deviation(
    panel: DataFrame, value: str, look_back: int = 60, at_least: int = 20
) -> DataFrame:
    """Standardise a value against the same asset and band over strictly prior sessions.

    ``panel`` carries asset, session_date, band and one value per origin.  Location is the
    median of the matching band; scale falls back from MAD to IQR to the asset-wide history.
    A history holds at most look_back sessions of origins, so its arrays are bounded.
    """
    days = panel.select("asset", "session_date").distinct().withColumn(
        "_r", F.row_number().over(Window.partitionBy("asset").orderBy("session_date"))
    )
    per_band = (
        panel.groupBy("asset", "session_date", "band").agg(F.collect_list(F.col(value).cast("double")).alias("_v"))
        .join(days, ["asset", "session_date"])
    )
    history = Window.partitionBy("asset", "band").orderBy("_r").rangeBetween(-look_back, -1)
    whole = (
        per_band.groupBy("asset", "session_date", "_r").agg(F.flatten(F.collect_list("_v")).alias("_w"))
        .withColumn("_w", F.flatten(F.collect_list("_w").over(
            Window.partitionBy("asset").orderBy("_r").rangeBetween(-look_back, -1))))
        .withColumn("_sessions", F.least(F.col("_r") - 1, F.lit(look_back)))
    )
    whole = _fit(whole, "_w", "a_").select("asset", "session_date", "_sessions", "a_scale")
    banded = per_band.withColumn("_h", F.flatten(F.collect_list("_v").over(history)))
    fitted = _fit(banded, "_h", "b_").select("asset", "session_date", "band", "b_center", "b_scale", "b_label")
    j = panel.join(fitted, ["asset", "session_date", "band"]).join(whole, ["asset", "session_date"])
    enough = F.col("_sessions") >= at_least
    center = F.coalesce("b_center", F.lit(0.0))
    known = F.col("b_center").isNotNull()
    scale = F.when(~known, 0.0).when(F.col("b_scale") > 0, F.col("b_scale")).otherwise(F.col("a_scale"))
    label = (
        F.when(~enough, "INSUFFICIENT").when(~known, "CONSTANT").when(F.col("b_scale") > 0, F.col("b_label"))
        .when(F.col("a_scale") > 0, "ASSET").otherwise("CONSTANT")
    )
    return j.select(
        *panel.columns,
        F.when(enough & (scale > 0), (F.col(value).cast("double") - center) / scale).otherwise(0.0).alias("deviation"),
        label.alias("label"), enough.alias("complete"),
        F.col("_sessions").cast("bigint").alias("history_sessions"),
    )


def frozen_calibration(panel: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Median and robust scale of log1p features per key, with the p95 of the unusual score.

    Exact percentiles by Spark's aggregate: a key holds one row per origin of one band.
    """
    lg = {f: F.log1p(F.greatest(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))) for f in features}
    p = panel.select(key, *[c.alias(f) for f, c in lg.items()])
    med = p.groupBy(key).agg(
        *[F.percentile(f, F.lit(0.5)).alias(f"{f}_median") for f in features],
        *[(F.percentile(f, F.lit(0.75)) - F.percentile(f, F.lit(0.25))).alias(f"{f}_iqr") for f in features],
        F.count(F.lit(1)).alias("sample_size"),
    )
    mad = p.join(med, key).groupBy(key).agg(
        *[F.percentile(F.abs(F.col(f) - F.col(f"{f}_median")), F.lit(0.5)).alias(f"{f}_mad") for f in features]
    )
    fitted = med.join(mad, key)
    for f in features:
        fitted = fitted.withColumn(
            f"{f}_scale",
            F.when(F.col(f"{f}_mad") > 0, 1.4826 * F.col(f"{f}_mad"))
            .when(F.col(f"{f}_iqr") > 0, F.col(f"{f}_iqr") / 1.349).otherwise(1.0),
        )
    fitted = fitted.drop(*[f"{f}_{x}" for f in features for x in ("mad", "iqr")])
    scored = p.join(fitted, key).withColumn("_score", unusual_score(features, log=False))
    cut = scored.groupBy(key).agg(F.percentile("_score", F.lit(0.95)).alias("threshold"))
    return fitted.join(cut, key)


def unusual_score(features: list[str], log: bool = True) -> Column:
    """Median of the three largest positive z values, zero when none is positive."""
    zs = []
    for f in features:
        x = F.col(f).cast("double")
        if log:
            x = F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
        zs.append((x - F.col(f"{f}_median")) / F.col(f"{f}_scale"))
    top = F.slice(F.sort_array(F.filter(F.array(*zs), lambda z: z > 0), asc=False), 1, 3)
    n = F.size(top)
    mid = F.when(n % 2 == 1, F.try_element_at(top, F.floor((n + 1) / 2).cast("int"))).otherwise(
        (F.try_element_at(top, F.greatest(F.floor(n / 2).cast("int"), F.lit(1)))
         + F.try_element_at(top, F.greatest(F.floor(n / 2).cast("int"), F.lit(1)) + 1)) / 2.0
    )
    return F.when(n == 0, 0.0).otherwise(mid)


def apply_calibration(panel: DataFrame, params: DataFrame, key: str, features: list[str]) -> DataFrame:
    j = panel.join(params, key, "left").withColumn("score", unusual_score(features))
    return j.select(
        *panel.columns, F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).alias("unusual"),
    )
