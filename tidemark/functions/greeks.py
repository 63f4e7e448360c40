"""Black-Scholes and Black-76 expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import floored
from .special import normal_cdf, normal_pdf

MIN_IV, MAX_IV = 0.01, 5.0
MIN_TENOR_YEARS = 60.0 / (365.25 * 24 * 3600)
HOUR_YEARS = 1.0 / (365.0 * 24.0)


class Greeks(NamedTuple):
    delta: Column
    gamma: Column
    vega: Column


def _clip_iv(iv: Column) -> Column:
    return F.when(iv > MAX_IV, MAX_IV).when(iv < MIN_IV, MIN_IV).otherwise(iv)


def greeks(spot: Column, strike: Column, tenor: Column, iv: Column, is_call: Column) -> Greeks:
    """Zero-rate delta, gamma and vega; a positive tenor is kept however small."""
    t = F.when(tenor > 0, tenor).otherwise(MIN_TENOR_YEARS)
    s = _clip_iv(iv)
    root = s * F.sqrt(t)
    x = floored(spot, 1e-9)
    d1 = (F.log(x / floored(strike, 1e-9)) + 0.5 * s * s * t) / root
    pdf = normal_pdf(d1)
    call = normal_cdf(d1)
    return Greeks(F.when(is_call, call).otherwise(call - 1.0), pdf / (x * root), x * pdf * F.sqrt(t))


def forward_delta(forward: Column, strike: Column, tenor: Column, iv: Column, is_call: Column) -> Column:
    """Black-76 delta against the forward, tenor floored at one hour."""
    t = floored(tenor, HOUR_YEARS)
    s = _clip_iv(iv)
    d1 = (
        F.log(floored(forward, 1e-9) / floored(strike, 1e-9)) + 0.5 * s * s * t
    ) / (s * F.sqrt(t))
    call = normal_cdf(d1)
    return F.when(is_call, call).otherwise(call - 1.0)


def bsm_price(
    spot: Column, strike: Column, tenor: Column, iv: Column, rate: Column, dividend: Column, is_call: Column
) -> Column:
    """Black-Scholes-Merton price; zero on invalid inputs."""
    root = iv * F.sqrt(tenor)
    d1 = (F.log(spot / strike) + (rate - dividend + 0.5 * iv * iv) * tenor) / root
    d2 = d1 - root
    dq, dr = spot * F.exp(-dividend * tenor), strike * F.exp(-rate * tenor)
    call = dq * normal_cdf(d1) - dr * normal_cdf(d2)
    put = dr * normal_cdf(-d2) - dq * normal_cdf(-d1)
    ok = (spot > 0) & (strike > 0) & (tenor > 0) & (iv > 0)
    return F.when(ok, F.when(is_call, call).otherwise(put)).otherwise(0.0)


def total_variance(iv: Column, tenor: Column) -> Column:
    s = _clip_iv(iv)
    return s * s * floored(tenor, 0.0)
