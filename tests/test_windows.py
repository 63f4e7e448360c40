"""Measures of overlapping windows against every window counted on its own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gaps, panes, quantiles

STEP = 300_000_000


def _clocks(seed, n, late, early):
    """Trades of a hot and a rare asset; shares of them become visible panes later or before their own pane."""
    g = np.random.default_rng(seed)
    t = g.integers(0, 12 * STEP, n) // 50_000_000 * 50_000_000 + g.integers(0, 3, n)
    delay = np.where(g.random(n) < late, g.integers(0, 5 * STEP, n), g.integers(0, 2_000_000, n))
    delay = np.where(g.random(n) < early, -g.integers(0, 2 * STEP, n), delay)
    return pd.DataFrame({"asset": np.where(g.random(n) < 0.8, "hot", "rare"), "executed_us": t, "created_us": t + delay})


def _held(p, k, width):
    start, seen = p["executed_us"] // STEP + width, -(-p["created_us"] // STEP)
    return p[(start >= k) & (seen <= k)]


@pytest.mark.parametrize(("n", "late", "early", "width"), [(400, 0.3, 0.1, 6), (60, 0.9, 0.0, 3), (300, 0.0, 0.0, 6), (120, 0.5, 0.5, 1)])
def test_window_gap_squares(spark, n, late, early, width):
    p = _clocks(n, n, late, early)
    rows = panes.with_panes(spark.createDataFrame(p), STEP)
    got = {(r["asset"], r["k"]): r["gap_squares"] for r in gaps.window_gap_squares(rows, ["asset"], "executed_us", width).collect()}
    want = {}
    for asset, part in p.groupby("asset"):
        for k in range(-5, 25):
            t = np.unique(_held(part, k, width)["executed_us"])
            if t.size:
                want[asset, k] = float(((np.diff(t) / 1e6) ** 2).sum())
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-6), key


def test_window_gap_squares_of_nulls_and_nothing(spark):
    schema = "asset string, executed_us bigint, created_us bigint"
    empty = panes.with_panes(spark.createDataFrame([], schema), STEP)
    assert gaps.window_gap_squares(empty, ["asset"], "executed_us", 6).count() == 0
    rows = [("a", None, 5), ("a", 5, None), ("a", 7, 9), ("a", 7, 9), ("b", 5, 90 * STEP)]
    out = gaps.window_gap_squares(panes.with_panes(spark.createDataFrame(rows, schema), STEP), ["asset"], "executed_us", 2).collect()
    assert sorted((r["asset"], r["k"], r["gap_squares"]) for r in out) == [("a", 1, 0.0), ("a", 2, 0.0)]


def test_window_quantiles(spark):
    p = _clocks(7, 500, 0.3, 0.1)
    p["v"] = np.where(np.arange(500) % 9 == 0, np.nan, np.round((p["created_us"] - p["executed_us"]) / 1e6, 1))
    rows = panes.with_panes(spark.createDataFrame(p), STEP)
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = quantiles.window_quantiles(
        rows, ["asset", "exec_pane", "seen_pane"], ["asset", "k"], lambda c: panes.spread(c, 6, False),
        F.when(~F.isnan("v"), F.col("v")), probs).toPandas().set_index(["asset", "k"])
    seen = 0
    for asset, part in p.dropna(subset="v").groupby("asset"):
        for k in range(-5, 25):
            v = _held(part, k, 6)["v"]
            if len(v):
                seen += 1
                for name, q in probs.items():
                    assert got.loc[(asset, k), name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12)
    assert seen == len(got)
