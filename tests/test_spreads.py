"""Zero prices in quantiles of spreads, and points exactly at the money."""

import math

import pytest

from tidemark.operators import diagnostics, quantiles, surface
from tidemark.plans.q_agg import attempts


def test_zero_price_has_no_finite_spread_and_counts_last(spark, tmp_path):
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-02 10:00:00' AS ts, 1L AS user_id, 'view' AS event_type,
      if(id = 0, 0.0D, 5.0D) AS value, '{"k": 1}' AS props FROM range(3)""").write.parquet(f"{tmp_path}/events.parquet")
    rows = attempts(spark, str(tmp_path))
    spreads = sorted((r["rel_spread"] for r in rows.collect()), key=lambda v: (math.isnan(v), v))
    assert math.isnan(spreads[2]) and spreads[:2] == pytest.approx([0.04, 0.04])
    whole = diagnostics.quote_quality(rows, ["asset", "tercile"]).where("asset = 'ALL' and tercile = 'ALL'").collect()[0]
    assert whole["attempts"] == 3 and whole["median_spread"] == pytest.approx(0.04) and math.isnan(whole["p95_spread"])


def test_quantiles_order_infinities_and_nan(spark):
    df = spark.createDataFrame([(v,) for v in (float("nan"), float("inf"), -float("inf"), 0.0, 1.0)], "v double")
    got = quantiles.group_quantiles(df, [], "v", {f"q{k}": k / 4 for k in range(5)}).collect()[0]
    assert [got[f"q{k}"] for k in range(4)] == [-float("inf"), 0.0, 1.0, float("inf")] and math.isnan(got["q4"])


def test_point_at_the_money_with_and_without_precedence(spark):
    df = spark.createDataFrame([(1, 14, 95.0, 0.95, 0.2), (1, 14, 100.0, 1.0, 0.9), (1, 14, 105.0, 1.05, 0.4)], "expiry int, dte int, strike double, moneyness double, iv double").selectExpr("1 AS k", "*")
    a = surface.atm_iv(df, ["k"], 14, 10).collect()[0]["iv"]
    b = surface.atm_iv(df, ["k"], 14, 10, exact_first=False).collect()[0]["iv"]
    x, y = math.log(0.95), math.log(1.05)
    assert a == 0.9 and b == pytest.approx(0.2 - x / (y - x) * 0.2)
