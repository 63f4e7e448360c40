"""Option-surface aggregates per forecast origin.

The input is one row per (origin, contract), so groups are bounded by the listed contracts of
one name; small sorted arrays per expiry are used for neighbour arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import greeks as GK
from ..functions.columns import MICROS, ceil_div, finite, floor_div, trade_direction
from ..functions.special import normal_cdf_array
from .robust import quantile_of

RATE_BAND = (-0.05, 0.25)
WING = 0.25
YEAR_DAYS = 365.0


def implied_forward(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Fit C - P on the strike per (origin, expiry): forward, discount, rate, yield, residual.

    ``pairs`` carries strike, call_mid, put_mid, tenor and spot.  Fewer than three strikes or a
    non-falling line leaves nulls; ``plausible`` bounds the rate.
    """
    p = pairs.withColumn("_y", F.col("call_mid") - F.col("put_mid"))
    r = p.groupBy(*keys).agg(
        F.count_distinct("strike").alias("pairs"), F.regr_slope("_y", "strike").alias("_b"),
        F.regr_intercept("_y", "strike").alias("_a"), F.regr_syy("_y", "strike").alias("_syy"),
        F.regr_sxy("_y", "strike").alias("_sxy"), F.regr_sxx("_y", "strike").alias("_sxx"), F.count(F.lit(1)).alias("_n"),
        F.max("tenor").alias("_t"), F.max("spot").alias("_s"))
    able = (F.col("pairs") >= 3) & (F.col("_t") > 0) & (F.col("_s") > 0)
    good = able & (F.col("_b") < 0)
    d, f = -F.col("_b"), F.col("_a") / -F.col("_b")
    sse = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    out = r.select(
        *keys, "pairs", F.when(good, f).alias("forward"), F.when(good, d).alias("discount"),
        F.when(good, -F.log(d) / F.col("_t")).alias("rate"),
        F.when(good & (f > 0), F.log(f / F.col("_s")) / F.col("_t")).alias("_carry"),
        F.when(able, F.sqrt(sse / F.col("_n"))).alias("parity_residual_std"))
    ok = (F.col("forward") > 0) & F.col("rate").between(*RATE_BAND)
    return out.withColumn("dividend_yield", F.col("rate") - F.col("_carry")).withColumn(
        "plausible", F.coalesce(ok, F.lit(False))).drop("_carry")


def smile_aggregates(k: Column, y: Column, prefix: str = "_m") -> list[Column]:
    """Moment sums of a quadratic smile, as aggregate columns."""
    ok = finite(k).isNotNull() & finite(y).isNotNull()
    kk, yy = F.when(ok, k), F.when(ok, y)
    return [
        F.count(kk).alias(f"{prefix}n"), F.count_distinct(kk).alias(f"{prefix}d"),
        *[F.sum(F.pow(kk, float(i))).alias(f"{prefix}k{i}") for i in (1, 2, 3, 4)],
        F.sum(yy).alias(f"{prefix}y"), F.sum(kk * yy).alias(f"{prefix}ky"), F.sum(kk * kk * yy).alias(f"{prefix}kky"),
        F.sum(yy * yy).alias(f"{prefix}yy"), F.min(kk).alias(f"{prefix}lo"), F.max(kk).alias(f"{prefix}hi")]


def smile_fit(df: DataFrame, prefix: str = "_m") -> DataFrame:
    """Level, slope, curvature and residual std of iv = a + bk + ck^2 from the moment sums.

    Three distinct strikes give the unique least squares fit by Cramer's rule.  Two give the
    minimum-norm interpolant, as a pseudo-inverse would.  Fewer than three points leave the
    mean level only.
    """
    c = {n: F.col(f"{prefix}{n}") for n in ("n", "d", "k1", "k2", "k3", "k4", "y", "ky", "kky", "yy", "lo", "hi")}
    n, s1, s2, s3, s4 = c["n"].cast("double"), c["k1"], c["k2"], c["k3"], c["k4"]
    y0, y1, y2 = c["y"], c["ky"], c["kky"]
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a = (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / det
    b = (n * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - y1 * s2)) / det
    q = (n * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)) / det
    # Two distinct strikes: interpolate both means with the smallest coefficients.
    lo, hi = c["lo"], c["hi"]
    w_hi = (s1 - n * lo) / (hi - lo)
    m_hi = ((y1 - lo * y0) / (hi - lo)) / w_hi
    m_lo = (y0 - (y1 - lo * y0) / (hi - lo)) / (n - w_hi)
    g11, g22 = 1 + lo * lo + F.pow(lo, 4.0), 1 + hi * hi + F.pow(hi, 4.0)
    g12 = 1 + lo * hi + lo * lo * hi * hi
    gd = g11 * g22 - g12 * g12
    u, v = (m_lo * g22 - m_hi * g12) / gd, (m_hi * g11 - m_lo * g12) / gd
    many, two = (c["n"] >= 3) & (c["d"] >= 3), (c["n"] >= 3) & (c["d"] == 2)
    level = F.when(many, a).when(two, u + v).when(c["n"] > 0, y0 / n)
    slope = F.when(many, b).when(two, u * lo + v * hi)
    curve = F.when(many, q).when(two, u * lo * lo + v * hi * hi)
    out = df.withColumn("level", level).withColumn("slope", slope).withColumn("curvature", curve)
    sse = c["yy"] - F.col("level") * y0 - F.col("slope") * y1 - F.col("curvature") * y2
    return out.withColumn(
        "residual_std", F.when(F.col("slope").isNotNull(), F.sqrt(F.greatest(sse / n, F.lit(0.0))))
    ).withColumn("points", c["n"])


def _bracket(x: Column, y: Column, cond: Column, at: float) -> list[Column]:
    """Aggregates of the points next to ``at``: the last at or below, the first at or above."""
    p = F.struct(x.alias("x"), y.alias("y"))
    return [
        F.max(F.when(cond & (x <= at), p)).alias("_below"), F.min(F.when(cond & (x >= at), p)).alias("_above"),
        F.count_if(cond).alias("_points")]


def wing_aggregates(delta: Column, iv: Column, wing: float = WING) -> list[Column]:
    """Bracketing call and put quotes of the wing delta, as aggregate columns."""
    ok = finite(delta).isNotNull() & finite(iv).isNotNull()
    out = []
    for side, x, cond in (("call", delta, ok & (delta > 0)), ("put", -delta, ok & (delta < 0))):
        out += [c.alias(f"_{side}{n}") for c, n in zip(_bracket(x, iv, cond, wing), ("_below", "_above", "_points"))]
    return out


def wing_iv(side: str, at: float = WING) -> Column:
    lo, hi = F.col(f"_{side}_below"), F.col(f"_{side}_above")
    w = F.when(hi["x"] > lo["x"], (at - lo["x"]) / (hi["x"] - lo["x"])).otherwise(0.0)
    return F.when((F.col(f"_{side}_points") >= 2) & lo.isNotNull() & hi.isNotNull(), lo["y"] + w * (hi["y"] - lo["y"]))


def interpolate(points: Column, at: float, x: str, y: str) -> Column:
    """Linear in a sorted array of structs, flat outside its range."""
    lo = F.try_element_at(F.filter(points, lambda p: p[x] <= at), F.lit(-1))
    hi = F.try_element_at(F.filter(points, lambda p: p[x] >= at), F.lit(1))
    w = F.when(hi[x] > lo[x], (at - lo[x]) / (hi[x] - lo[x])).otherwise(0.0)
    return F.when(lo.isNull(), hi[y]).when(hi.isNull(), lo[y]).otherwise(lo[y] + w * (hi[y] - lo[y]))


def count_falls(points: Column, y: str) -> Column:
    """Neighbours in a sorted array whose ``y`` decreases."""
    n = F.size(points)
    return F.when(n < 2, 0).otherwise(F.size(F.filter(
        F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
        lambda i: F.try_element_at(points, i)[y] < F.try_element_at(points, i - 1)[y]))).cast("bigint")


def model_free_variance(points: Column, forward: Column, tenor: Column) -> Column:
    """VIX-style sum over a strike-sorted array of (strike, mid), edge widths one-sided."""
    n = F.size(points)

    def term(p: Column, i: Column) -> Column:
        left = F.try_element_at(points, F.greatest(i, F.lit(1)))["strike"]
        right = F.try_element_at(points, F.least(i + 2, n))["strike"]
        width = F.when((i == 0) | (i == n - 1), right - left).otherwise((right - left) / 2.0)
        return width / (p["strike"] * p["strike"]) * p["mid"]

    total = F.aggregate(F.transform(points, term), F.lit(0.0), lambda s, x: s + x)
    below = F.filter(points, lambda p: p["strike"] <= forward)
    k0 = F.when(F.size(below) > 0, F.try_element_at(below, F.lit(-1))["strike"]).otherwise(F.try_element_at(points, F.lit(1))["strike"])
    return F.when((n >= 3) & (tenor > 0), 2.0 / tenor * total - F.pow(forward / k0 - 1.0, 2.0) / tenor)


def count_concave(points: Column) -> Column:
    """Strike triples whose middle call price lies above the chord."""
    n = F.size(points)

    def bad(i: Column) -> Column:
        a, b, c = (F.try_element_at(points, i - 1), F.try_element_at(points, i), F.try_element_at(points, i + 1))
        w = (c["strike"] - b["strike"]) / (c["strike"] - a["strike"])
        return b["mid"] > w * a["mid"] + (1.0 - w) * c["mid"] + 1e-9

    return F.when(n < 3, 0).otherwise(
        F.size(F.filter(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), bad))).cast("bigint")


def unique_by_strike(points: Column) -> Column:
    """First point per strike of a sorted array."""
    return F.filter(points, lambda p, i: (i == 0) | (p["strike"] != F.try_element_at(points, F.greatest(i, F.lit(1)))["strike"]))


def parity_residual(pairs: Column, forward: Column, discount: Column, scale: Column) -> Column:
    """Median absolute C - P - D (F - K) over scale, from an array of pairs."""
    r = F.sort_array(F.transform(pairs, lambda p: F.abs(p["call_mid"] - p["put_mid"] - discount * (forward - p["strike"]))))
    return F.when((scale > 0) & forward.isNotNull(), quantile_of(r, 0.5) / scale)


def expiry_surface(quotes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(quotes with forward, log moneyness and delta; one row per origin and expiry).

    ``quotes`` holds live contracts: strike, expiry, option_type, iv, bid, ask, spot, tenor.
    """
    ek = [*keys, "expiry"]
    q = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2.0).withColumn("is_call", F.col("option_type") == "call")
    strikes = q.groupBy(*ek, "strike").agg(
        F.max(F.when(F.col("is_call"), F.col("mid"))).alias("call_mid"), F.max(F.when(~F.col("is_call"), F.col("mid"))).alias("put_mid"),
        F.max("tenor").alias("tenor"), F.max("spot").alias("spot"))
    pairs = strikes.where(F.col("call_mid").isNotNull() & F.col("put_mid").isNotNull())
    fit = implied_forward(pairs, ek)
    pair_rows = pairs.groupBy(*ek).agg(F.collect_list(F.struct("strike", "call_mid", "put_mid")).alias("_pairs"))
    fit = fit.join(pair_rows, ek)
    rows = q.join(fit.select(*ek, F.when(F.col("plausible"), F.col("forward")).alias("_f")), ek, "left").withColumn(
        "fwd", F.coalesce("_f", "spot")).drop("_f").withColumn("log_moneyness", F.log(F.greatest("strike", F.lit(1e-9)) / F.col("fwd")))
    rows = rows.withColumn("delta", GK.forward_delta(F.col("fwd"), F.col("strike"), F.col("tenor"), F.col("iv"), F.col("is_call")))
    point = F.struct("strike", "mid")
    otm = F.when(F.col("is_call"), F.col("strike") >= F.col("fwd")).otherwise(F.col("strike") <= F.col("fwd"))
    per = rows.groupBy(*ek).agg(
        *smile_aggregates(F.col("log_moneyness"), F.col("iv")), *wing_aggregates(F.col("delta"), F.col("iv")),
        F.max("tenor").alias("tenor"), F.max("fwd").alias("fwd"), F.max("spot").alias("spot"),
        F.sort_array(F.collect_list(F.when(otm & (F.col("mid") > 0), point))).alias("_otm"),
        F.sort_array(F.collect_list(F.when(F.col("is_call"), point))).alias("_calls"))
    per = smile_fit(per).join(fit, ek, "left")
    per = per.withColumns({
        "call_wing": wing_iv("call"), "put_wing": wing_iv("put"), "mfiv": model_free_variance(F.col("_otm"), F.col("fwd"), F.col("tenor")),
        "butterfly_violations": count_concave(unique_by_strike(F.col("_calls"))),
        "pcp_residual": F.when(F.col("pairs") >= 3, parity_residual(F.col("_pairs"), F.col("forward"), F.col("discount"), F.col("spot")))})
    keep = [c for c in per.columns if not c.startswith("_")]
    return rows, per.select(*keep)


def coverage_aggregates(wing: float = WING) -> list[Column]:
    d = F.col("delta")
    return [
        F.count("log_moneyness").alias("contracts"), F.count_distinct(F.round("tenor", 8)).alias("expiries"),
        F.count_distinct("strike").alias("strikes"), F.min("log_moneyness").alias("min_log_moneyness"),
        F.max("log_moneyness").alias("max_log_moneyness"),
        (F.bool_or(d <= wing) & F.bool_or(d >= 0.5)).alias("spans_call_wing"),
        (F.bool_or(d >= -wing) & F.bool_or(d <= -0.5)).alias("spans_put_wing"),
        F.count_if(F.col("tenor") < 1.0 / YEAR_DAYS).alias("zero_dte_contracts")]


def surface_record(quotes: DataFrame, keys: list[str], maturities: tuple[int, ...] = (7, 30, 60, 90)) -> DataFrame:
    """Surface features per origin from its live contracts; origins under three drop out."""
    n = quotes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_live"))
    live = quotes.join(n.where(F.col("_live") >= 3).select(*keys), keys, "left_semi")
    rows, per = expiry_surface(live, keys)
    spread = (F.col("ask") - F.col("bid")) / F.greatest(F.col("mid"), F.lit(1e-9))
    cover = rows.groupBy(*keys).agg(
        *coverage_aggregates(), F.percentile("quote_age_s", F.lit(0.5)).alias("median_quote_age_s"),
        F.percentile("quote_age_s", F.lit(0.95)).alias("p95_quote_age_s"), F.percentile(spread, F.lit(0.5)).alias("median_relative_spread"))
    w = GK.total_variance(F.col("level"), F.col("tenor"))
    fits = (F.col("points") >= 3) & (F.col("level") > 0) & (F.col("tenor") > 0)
    near = F.struct(F.abs(F.col("tenor") - 30.0 / YEAR_DAYS).alias("d"), F.col("tenor").alias("t"))
    shape = F.struct("points", "level", "slope", "curvature", "residual_std", "call_wing", "put_wing", "mfiv", "butterfly_violations",
                     "pcp_residual", "plausible", "rate", "dividend_yield", "pairs")
    term = per.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(fits, F.struct(F.col("tenor").alias("t"), w.alias("w"))))).alias("_term"),
        F.min_by(shape, near).alias("_b"), F.count_if(F.coalesce("plausible", F.lit(False))).alias("forward_expiries_fitted"))
    out = cover.join(term, keys)
    two = F.size("_term") >= 2
    iv = {d: F.when(two, F.sqrt(F.greatest(interpolate(F.col("_term"), d / YEAR_DAYS, "t", "w"), F.lit(0.0)) / (d / YEAR_DAYS))) for d in maturities}
    out = out.withColumns({f"iv_{d}d": c for d, c in iv.items()})
    b = F.col("_b")
    shaped = two & (b["points"] >= 3)
    flags = [F.col("contracts") >= 3, F.col("spans_call_wing"), F.col("spans_put_wing"), F.col("expiries") >= 2]
    return out.withColumns({
        "surface_coverage": sum((f.cast("double") for f in flags), F.lit(0.0)) / 4.0,
        "calendar_violations": F.when(two, count_falls(F.col("_term"), "w")),
        "term_slope": F.col("iv_60d") - F.col("iv_7d"),
        "term_convexity": F.col("iv_7d") - 2.0 * F.col("iv_30d") + F.col("iv_90d"),
        **{f"smile_{n}": F.when(shaped, b[n]) for n in ("level", "slope", "curvature")},
        "smile_residual": F.when(shaped, b["residual_std"]),
        "risk_reversal_25": F.when(shaped, b["call_wing"] - b["put_wing"]),
        "butterfly_25": F.when(shaped, 0.5 * (b["call_wing"] + b["put_wing"]) - b["level"]),
        "mfiv": F.when(shaped, b["mfiv"]), "butterfly_violations": F.when(shaped, b["butterfly_violations"]),
        "pcp_residual": F.when(shaped, b["pcp_residual"]),
        "implied_rate": F.when(shaped & b["plausible"], b["rate"]),
        "implied_dividend_yield": F.when(shaped & b["plausible"], b["dividend_yield"]),
    }).drop("_term", "_b")


def endpoint_discount(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Discount factor from the lowest and highest paired strike of each expiry."""
    y = F.col("call_mid") - F.col("put_mid")
    e = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paired_strikes"), F.min("strike").alias("_lo"), F.max("strike").alias("_hi"),
        F.min_by(y, "strike").alias("_ylo"), F.max_by(y, "strike").alias("_yhi"))
    return e.select(*keys, "paired_strikes", F.when(
        F.col("paired_strikes") >= 2, (F.col("_ylo") - F.col("_yhi")) / (F.col("_hi") - F.col("_lo"))).alias("discount_factor"))


def parity_feasibility(origins: DataFrame, pairs: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Share of origins with pairs and with a two-strike expiry, per asset."""
    per = pairs.groupBy(*keys, "expiry").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum("_n").alias("pairs"), F.count_if(F.col("_n") >= 2).alias("_two"))
    j = origins.join(per, keys, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("bigint")))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("origins"), F.count_if(F.col("pairs") > 0).alias("with_pairs"),
        F.count_if(F.coalesce("_two", F.lit(0)) > 0).alias("with_two_strikes"), F.percentile("pairs", F.lit(0.5)).alias("median_pairs"))


def atm_iv(
    points: DataFrame, keys: list[str], target: int, tolerance: int, min_dte: int = 1, nearest: float = math.log(1.025), exact_first: bool = True,
) -> DataFrame:
    """ATM volatility of the expiry nearest a tenor: exact, bracketed in log moneyness, or nearest.

    ``points`` carries expiry, strike, dte, moneyness and iv of call/put pairs.  Without ``exact_first``
    a point at the money counts only as the nearest, where there is no bracket.
    """
    gap = F.abs(F.col("dte") - target)
    eligible = points.where((F.col("dte") >= min_dte) & (gap <= tolerance))
    x = F.log("moneyness")
    exact = F.abs(F.col("moneyness") - 1.0) <= 1e-12 if exact_first else F.col("moneyness") == 1.0
    p = F.struct(x.alias("x"), F.col("strike"), F.col("iv"))
    per = eligible.groupBy(*keys, "expiry", "dte").agg(
        F.min(F.when(exact, p)).alias("_e"), F.max(F.when(~exact & (x < 0), p)).alias("_lo"), F.min(F.when(~exact & (x > 0), p)).alias("_hi"),
        F.min(F.struct(F.abs(x).alias("d"), F.col("strike"), F.col("iv"))).alias("_near"))
    lo, hi = F.col("_lo"), F.col("_hi")
    iv = (
        F.when(F.lit(exact_first) & F.col("_e").isNotNull(), F.col("_e.iv"))
        .when(lo.isNotNull() & hi.isNotNull(), lo["iv"] - lo["x"] / (hi["x"] - lo["x"]) * (hi["iv"] - lo["iv"]))
        .when(F.col("_near.d") <= nearest, F.col("_near.iv")))
    row = F.struct("expiry", "dte", iv.alias("iv"))
    return per.groupBy(*keys).agg(F.min_by(row, F.struct(F.abs(F.col("dte") - target), "expiry")).alias("_r")).select(*keys, "_r.*")


def side_iv(rows: DataFrame, keys: list[str], option_type: str, target: float, within: float, name: str) -> DataFrame:
    """Volatility of one side at a moneyness: exact, bracketed in log, or nearest within a bound."""
    m = F.col("moneyness")
    x, tx = F.log(m), math.log(target)
    exact = F.abs(m - target) <= 1e-12
    p = F.struct(x.alias("x"), F.col("iv"))
    per = rows.where(F.col("option_type") == option_type).groupBy(*keys).agg(
        F.min(F.when(exact, p)).alias("_e"), F.max(F.when(~exact & (m < target), p)).alias("_lo"), F.min(F.when(~exact & (m > target), p)).alias("_hi"),
        F.min(F.struct(F.abs(m - target).alias("d"), F.col("strike"), F.col("iv"))).alias("_near"))
    lo, hi = F.col("_lo"), F.col("_hi")
    iv = (
        F.when(F.col("_e").isNotNull(), F.col("_e.iv"))
        .when(lo.isNotNull() & hi.isNotNull(), lo["iv"] + (tx - lo["x"]) / (hi["x"] - lo["x"]) * (hi["iv"] - lo["iv"]))
        .when(F.col("_near.d") <= within, F.col("_near.iv")))
    return per.select(*keys, iv.alias(name))


def symmetric_skew(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ln(put iv at 0.975 / call iv at 1.025)."""
    put = side_iv(rows, keys, "put", 0.975, 0.0125, "put_iv")
    call = side_iv(rows, keys, "call", 1.025, 0.0125, "call_iv")
    ok = (F.col("put_iv") > 0) & (F.col("call_iv") > 0)
    return put.join(call, keys).where(ok).withColumn("log_skew", F.log(F.col("put_iv") / F.col("call_iv")))


def level_summary(rows: DataFrame, keys: list[str], buckets: dict[str, tuple[int, int]]) -> DataFrame:
    """ATM level per tenor bucket, skew of the middle bucket and term differences.

    ATM is linear between the nearest contracts at or below and at or above the spot, else the
    nearest; skew is the same-expiry put near 0.975 less the call near 1.025.
    """
    m, aggs = F.col("moneyness"), []
    for name, (a, b) in buckets.items():
        inside = F.col("dte").between(a, b)
        row = F.struct("moneyness", "contract", "iv")
        aggs += [
            F.min_by(F.when(inside & (m <= 1), row), F.when(inside & (m <= 1), F.struct(1 - m, F.col("contract")))).alias(f"_{name}_lo"),
            F.min_by(F.when(inside & (m >= 1), row), F.when(inside & (m >= 1), F.struct(m - 1, F.col("contract")))).alias(f"_{name}_hi"),
            F.min_by(F.when(inside, row), F.when(inside, F.struct(F.abs(m - 1), F.col("contract")))).alias(f"_{name}_near")]
    lv = rows.groupBy(*keys).agg(*aggs)

    def level(n: str) -> Column:
        lo, hi = F.col(f"_{n}_lo"), F.col(f"_{n}_hi")
        same = (lo["contract"] == hi["contract"]) | (lo["moneyness"] == hi["moneyness"])
        w = (1.0 - lo["moneyness"]) / (hi["moneyness"] - lo["moneyness"])
        return F.when(lo.isNotNull() & hi.isNotNull(), F.when(same, lo["iv"]).otherwise(lo["iv"] + w * (hi["iv"] - lo["iv"]))).otherwise(
            F.col(f"_{n}_near.iv"))

    short, medium, long = buckets
    a, b = buckets[medium]
    mid = rows.where(F.col("dte").between(a, b))
    put = (F.col("option_type") == "put") & (m <= 0.99)
    call = (F.col("option_type") == "call") & (m >= 1.01)

    def nearest(cond: Column, at: float, alias: str) -> Column:
        d = F.abs(m - at)
        return F.min(F.when(cond, F.struct(d.alias("d"), F.col("contract"), F.col("iv")))).alias(alias)

    per = mid.groupBy(*keys, "expiry").agg(nearest(put, 0.975, "_p"), nearest(call, 1.025, "_c")).where(
        F.col("_p").isNotNull() & F.col("_c").isNotNull())
    skew = per.groupBy(*keys).agg(F.min(F.struct(
        (F.col("_p.d") + F.col("_c.d")).alias("d"), (F.col("_p.iv") - F.col("_c.iv")).alias("s"))).alias("_s")).select(
        *keys, F.col("_s.s").alias("skew"))
    out = lv.select(*keys, *[level(n).alias(f"atm_{n}") for n in buckets])
    return out.join(skew, keys, "left").withColumns({
        "term_short_medium": F.col(f"atm_{medium}") - F.col(f"atm_{short}"),
        "term_medium_long": F.col(f"atm_{long}") - F.col(f"atm_{medium}")})


def select_grid(chain: DataFrame, keys: list[str], buckets: dict[str, tuple[int, int]], targets: list[float], within: float = 0.04) -> DataFrame:
    """Best contract per (tenor bucket, moneyness target, side) by a five-part tie break.

    A reduction by minimum, so no group is sorted; two different rows of one contract fail.
    """
    one = chain.groupBy(*keys, "contract").agg(
        F.min(F.struct("expiry", "strike", "option_type", "dte", "moneyness")).alias("_a"),
        F.max(F.struct("expiry", "strike", "option_type", "dte", "moneyness")).alias("_b"))
    clash = ~F.col("_a").eqNullSafe(F.col("_b"))
    uniq = one.where(F.when(clash, F.raise_error(F.lit("contract metadata conflict")).cast("boolean")).otherwise(True)).select(*keys, "contract", "_a.*")
    bucket = F.lit(None).cast("string")
    mid = F.lit(None).cast("double")
    for name, (a, b) in buckets.items():
        inside = F.col("dte").between(a, b)
        bucket, mid = F.when(inside, name).otherwise(bucket), F.when(inside, (a + b) / 2.0).otherwise(mid)
    t = uniq.withColumn("bucket", bucket).withColumn("_mid", mid).where(F.col("bucket").isNotNull())
    t = t.withColumn("target", F.explode(F.array(*[F.lit(float(x)) for x in targets])))
    t = t.withColumn("distance", F.abs(F.col("moneyness") - F.col("target"))).where(F.col("distance") <= within)
    rank = F.struct("distance", F.abs(F.col("dte") - F.col("_mid")).alias("g"), "expiry", "strike", "contract")
    return t.groupBy(*keys, "bucket", "target", "option_type").agg(F.min(rank).alias("_r")).select(
        *keys, "bucket", "target", "option_type", F.col("_r.contract").alias("contract"), F.col("_r.strike").alias("strike"),
        F.col("_r.expiry").alias("expiry"), F.col("_r.distance").alias("distance"))


def trade_legs(snapshot: DataFrame, keys: list[str], target_dte: int = 30) -> DataFrame:
    """One call per origin: the expiry nearest a tenor, the strike nearest the spot.

    ``snapshot`` has the latest quote of each contract at the entry cutoff with spot and dte.
    """
    live = snapshot.where(F.col("dte") > 0)
    n = snapshot.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pick = live.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("dte") - target_dte).alias("d"), F.col("created_us"), F.col("dte"))).alias("_d")).select(
        *keys, F.col("_d.dte").alias("dte"))
    rest = [c for c in snapshot.columns if c not in (*keys, "dte")]
    calls = live.join(pick, [*keys, "dte"]).where(F.col("option_type") == "call").groupBy(*keys, "dte").agg(
        F.min_by(F.struct(*rest), F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("created_us"), F.col("contract"))).alias("_c"))
    return calls.join(n.where(F.col("_n") >= 3).select(*keys), keys, "left_semi").select(*keys, "dte", "_c.*")


def trade_tensor(
    tape: DataFrame, origins: DataFrame, step_us: int, panes: int, cutoff_s: int,
    moneyness_edges: tuple[float, ...], dte_edges: tuple[int, ...],
) -> DataFrame:
    """Signed vega flow and premium per origin and (moneyness, tenor, side) cell, long form.

    The window is closed at both ends on the availability clock.  Trades sum per (asset, pane,
    cell) first; those exactly on a pane boundary are kept apart, for the window that starts
    there.
    """
    t = tape.withColumn("dte", F.greatest(F.datediff("expiry", "session_date"), F.lit(1)).cast("double"))
    is_call = F.col("option_type") == "call"
    g = GK.greeks(F.col("mark"), F.col("strike"), F.col("dte") / YEAR_DAYS, F.col("iv"), is_call)
    d = trade_direction(F.col("tags"))
    lm = F.log(F.greatest("strike", F.lit(1e-9)) / F.greatest("mark", F.lit(1e-9)))

    def bucket(x: Column, edges: tuple) -> Column:
        return sum(((x > e).cast("bigint") for e in edges), F.lit(0).cast("bigint"))

    cell = (bucket(lm, moneyness_edges) * (len(dte_edges) + 1) + bucket(F.col("dte"), dte_edges)) * 2 + is_call.cast("bigint")
    shifted = F.col("created_us") + F.lit(cutoff_s * MICROS)
    rows = t.select(
        "asset", ceil_div(shifted, step_us).alias("_p"), (F.pmod(shifted, F.lit(step_us).cast("bigint")) == 0).alias("_edge"),
        cell.alias("cell"), (g.vega * F.col("size") * 100.0 * d).alias("_v"), (F.col("premium") * d).alias("_s"))
    cells = rows.groupBy("asset", "_p", "_edge", "cell").agg(F.sum("_v").alias("_v"), F.sum("_s").alias("_s"))
    last = F.col("_p") + F.when(F.col("_edge"), panes).otherwise(panes - 1)
    wide = cells.withColumn("k", F.explode(F.sequence("_p", last))).groupBy("asset", "k", "cell").agg(
        F.sum("_v").alias("vega_flow"), F.sum("_s").alias("signed_premium"))
    o = origins.withColumn("k", floor_div(F.col("origin_us"), step_us)).select("origin_id", "asset", "k")
    return o.join(wide, ["asset", "k"]).select("origin_id", "cell", "vega_flow", "signed_premium")


def last_trades(tape: DataFrame, origins: DataFrame, step_us: int, panes: int, cutoff_s: int, n: int, values: list[str]) -> DataFrame:
    """The most recent ``n`` records of each origin's window as one array, oldest first.

    Each pane keeps its last n records only, which is enough because a window's last n lie
    among its panes' last n; the array is the operator's own bounded output.
    """
    shifted = F.col("created_us") + F.lit(cutoff_s * MICROS)
    row = F.struct("created_us", "id", *values)
    w = Window.partitionBy("asset", "_p").orderBy(F.desc("created_us"), F.desc("id"))
    edge = F.pmod(shifted, F.lit(step_us).cast("bigint")) == 0
    # Spark turns the rank filter into a per-task top-n before the shuffle.
    kept = tape.withColumn("_p", ceil_div(shifted, step_us)).withColumn("_edge", edge).withColumn(
        "_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    last = F.col("_p") + F.when(F.col("_edge"), panes).otherwise(panes - 1)
    arrays = kept.withColumn("k", F.explode(F.sequence("_p", last))).groupBy("asset", "k").agg(
        F.sort_array(F.collect_list(row)).alias("_a"))
    o = origins.withColumn("k", floor_div(F.col("origin_us"), step_us)).select("origin_id", "asset", "k")
    tail = F.slice("_a", F.greatest(F.size("_a") - n + 1, F.lit(1)), n)
    return o.join(arrays, ["asset", "k"]).select("origin_id", tail.alias("trades"))


@F.pandas_udf(T.DoubleType())
def _bisect_iv(
    price: pd.Series, spot: pd.Series, strike: pd.Series, tenor: pd.Series, rate: pd.Series, dividend: pd.Series, is_call: pd.Series
) -> pd.Series:
    """Sixty halvings of [1e-6, 5] for the rows of an Arrow batch that have a price; null for the rest."""
    out = np.full(len(price), np.nan)
    todo = price.notna().to_numpy()
    p, s, k, t, r, q = (c[todo].to_numpy(dtype=float) for c in (price, spot, strike, tenor, rate, dividend))
    sign = np.where(is_call[todo].fillna(False).astype(bool), 1.0, -1.0)
    fs, fk, root, x = s * np.exp(-q * t), k * np.exp(-r * t), np.sqrt(t), np.log(s / k)
    lo, hi = np.full(len(p), 1e-6), np.full(len(p), 5.0)
    for _ in range(60 if len(p) else 0):
        mid = (lo + hi) / 2.0
        d1 = (x + (r - q + 0.5 * mid * mid) * t) / (mid * root)
        high = sign * (fs * normal_cdf_array(sign * d1) - fk * normal_cdf_array(sign * (d1 - mid * root))) > p
        lo, hi = np.where(high, lo, mid), np.where(high, mid, hi)
    out[todo] = (lo + hi) / 2.0
    return pd.Series(out).astype(object).where(todo, None).astype("Float64")


def implied_volatility(df: DataFrame, price: str, spot: str, strike: str, tenor: str, rate: str, dividend: str) -> DataFrame:
    """Volatility from a mid price by bisection on [1e-6, 5], with a reason where it fails.

    Bounds and reasons are column expressions; only rows inside them reach the batched solver's
    result.
    """
    is_call = F.col("option_type") == "call"
    s, k, t, r, q, p = (F.col(c) for c in (spot, strike, tenor, rate, dividend, price))
    fs, fk = s * F.exp(-q * t), k * F.exp(-r * t)
    lower = F.greatest(F.lit(0.0), F.when(is_call, fs - fk).otherwise(fk - fs))
    upper = F.when(is_call, fs).otherwise(fk)
    top = GK.bsm_price(s, k, t, F.lit(5.0), r, q, is_call)
    out = df.withColumn(
        "reason",
        F.when(p.isNull() | s.isNull() | (t <= 0), "INVALID_INPUT").when((p < lower) | (p > upper) | (p <= 0), "ARBITRAGE_BOUND")
        .when(top < p, "IV_UPPER_BOUND"))
    solved = _bisect_iv(F.when(F.col("reason").isNull(), p), s, k, t, r, q, is_call)
    return out.withColumn("implied_vol", solved)


def compare_surfaces(traded: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """The same smile fitted to two quote sets over the listed side's moneyness span."""
    span = listed.groupBy(*keys).agg(F.min("log_moneyness").alias("_a"), F.max("log_moneyness").alias("_b"))
    inside = F.col("log_moneyness").between(F.col("_a"), F.col("_b"))

    def fit(df: DataFrame, name: str) -> DataFrame:
        m = df.join(span, keys).where(inside).groupBy(*keys).agg(
            *smile_aggregates(F.col("log_moneyness"), F.col("iv")), F.avg("iv").alias("_mean"))
        return smile_fit(m).select(
            *keys, F.col("points").alias(f"{name}_points"), F.col("_mean").alias(f"{name}_mean"),
            *[F.col(c).alias(f"{name}_{c}") for c in ("level", "slope", "curvature")])

    j = fit(traded, "traded").join(fit(listed, "listed"), keys)
    return j.withColumns({
        "mean_iv_difference": F.col("traded_mean") - F.col("listed_mean"),
        **{f"{c}_difference": F.col(f"traded_{c}") - F.col(f"listed_{c}") for c in ("level", "slope", "curvature")}})
