"""Statistics and models against independent numpy versions."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import greeks, special
from tidemark.functions.columns import qlike, transform
from tidemark.operators import inference, models, realized, regression, surface


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def test_tails_match_tables(spark):
    r = one(spark, special.t_two_sided(F.lit(2.228138852), F.lit(10)).alias("a"), special.t_two_sided(F.lit(2.364624252), F.lit(7)).alias("b"),
            special.t_two_sided(F.lit(12.70620474), F.lit(1)).alias("c"), special.chi2_sf(F.lit(7.814727903), 3).alias("d"), special.chi2_sf(F.lit(9.487729037), 4).alias("e"),
            special.t_quantile(0.975, F.lit(30)).alias("q"))
    assert [r[x] for x in "abcde"] == pytest.approx([0.05] * 5, abs=1e-6)
    assert r["q"] == pytest.approx(2.042272456, abs=1e-5)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-6, 1e3), st.floats(1e-6, 1e3)), min_size=1, max_size=30))
def test_qlike_is_nonnegative(spark, pairs):
    out = spark.createDataFrame(pairs, "a double, f double").select(qlike(F.col("a"), F.col("f")).alias("q"), "a", "f").collect()
    assert all(r["q"] >= -1e-12 for r in out)


def test_nulls_stay_null(spark):
    r = one(spark, transform(F.lit(None).cast("double"), "log").alias("a"), qlike(F.lit(1.0), F.lit(None).cast("double")).alias("b"), qlike(F.lit(0.0), F.lit(1.0)).alias("c"))
    assert r["a"] is None and r["b"] is None and r["c"] is None


def test_forward_measures_by_hand(spark):
    c = np.array([100.0, 101.0, 100.5, 102.0, 101.0, 103.0])
    df = spark.createDataFrame([("x", "s", i, float(v)) for i, v in enumerate(c)], "asset string, session_date string, bar int, close double")
    out = realized.forward_measures(realized.log_returns(df), [3]).orderBy("bar").collect()
    r = np.diff(np.log(c))[1:4]
    row = out[1]
    assert row["rv_3"] == pytest.approx((r**2).sum())
    assert row["bv_3"] == pytest.approx(math.pi / 2 * (abs(r[0] * r[1]) + abs(r[1] * r[2])))
    assert row["rq_3"] == pytest.approx((r**4).sum())
    assert row["up_3"] + row["down_3"] == pytest.approx(row["rv_3"])
    assert out[3]["rv_3"] is None


def test_implied_volatility_round_trip(spark):
    rows = [(100.0, k, t, s, o) for k in (90.0, 100.0, 110.0) for t in (0.1, 1.0) for s in (0.15, 0.6) for o in ("call", "put")]
    df = spark.createDataFrame(rows, "spot double, strike double, t double, s double, option_type string").withColumns({"r": F.lit(0.03), "q": F.lit(0.01)})
    df = df.withColumn("mid", greeks.bsm_price(F.col("spot"), F.col("strike"), F.col("t"), F.col("s"), F.col("r"), F.col("q"), F.col("option_type") == "call"))
    for r in surface.implied_volatility(df, "mid", "spot", "strike", "t", "r", "q").collect():
        assert r["reason"] == "ARBITRAGE_BOUND" or r["implied_vol"] == pytest.approx(r["s"], abs=2e-4)


@pytest.mark.parametrize("ks", [[-0.2, -0.1, 0.0, 0.15, 0.3], [-0.1, -0.1, 0.2, 0.2]])
def test_smile_fit_equals_lstsq(spark, ks):
    y = [0.3 + 0.1 * i for i in range(len(ks))]
    df = spark.createDataFrame(list(zip(ks, y)), "k double, y double").groupBy().agg(*surface.smile_aggregates(F.col("k"), F.col("y")))
    got = surface.smile_fit(df).collect()[0]
    k = np.array(ks)
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones_like(k), k, k**2]), np.array(y), rcond=None)
    assert [got["level"], got["slope"], got["curvature"]] == pytest.approx(want.tolist(), abs=1e-8)


def test_splines_sum_to_one(spark):
    x = spark.createDataFrame([(v,) for v in np.linspace(-1, 2, 31).tolist()], "x double")
    for r in x.select(F.array(*models.spline_basis(F.col("x"), 0.0, 1.0)).alias("b")).collect():
        assert 0.8 < sum(r["b"]) <= 1.0 + 1e-12 or sum(r["b"]) == pytest.approx(1 - 1 / 6, abs=0.2)


def test_preprocessor_uses_training_rows_only(spark):
    rows = [(1.0, True), (3.0, True), (None, True), (1000.0, False), (None, False)]
    p = models.fit_preprocessor(spark.createDataFrame(rows, "x double, t boolean"), ["x"], F.col("t"))
    assert (p.median["x"], p.mean["x"], p.indicators) == (2.0, 2.0, ("x",))
    assert p.scale["x"] == pytest.approx(np.std([1.0, 3.0, 2.0]))
    with pytest.raises(ValueError):
        models.fit_preprocessor(spark.createDataFrame([(None, True)], "x double, t boolean"), ["x"], F.col("t"))


def test_double_ml_equals_numpy(spark):
    g = np.random.default_rng(7)
    n, sessions = 600, 24
    s = np.sort(g.integers(0, sessions, n))
    x = g.normal(size=(n, 2))
    d = x @ np.array([[0.5], [0.2]]) + g.normal(size=(n, 1))
    y = 1.0 + x @ np.array([1.0, -1.0]) + 0.7 * d[:, 0] + g.normal(size=n)
    p = pd.DataFrame({"k": "a", "session_date": pd.to_datetime("2024-01-01") + pd.to_timedelta(s, unit="D"), "y": y, "d": d[:, 0], "x0": x[:, 0], "x1": x[:, 1]})
    df = spark.createDataFrame(p).withColumn("session_date", F.to_date("session_date"))
    got = regression.double_ml(df, ["k"], F.col("y"), {"d": F.col("d")}, [F.lit(1.0), F.col("x0"), F.col("x1")], 4).collect()[0]
    z = np.column_stack([np.ones(n), x])
    rank = np.unique(s, return_inverse=True)[1]
    ry, rd = np.zeros(n), np.zeros(n)
    for chunk in np.array_split(np.unique(rank), 4):
        a, b = chunk[0], chunk[-1]
        te, tr = (rank >= a) & (rank <= b), (rank < a - 1) | (rank > b + 1)
        for v, out in ((y, ry), (d[:, 0], rd)):
            w = np.linalg.solve(z[tr].T @ z[tr] + 1e-6 * np.eye(3), z[tr].T @ v[tr])
            out[te] = v[te] - z[te] @ w
    theta = (rd @ ry) / (rd @ rd)
    u = np.array([(rd * (ry - theta * rd))[rank == c].sum() for c in np.unique(rank)])
    m = u.size
    se = math.sqrt((u @ u) / (rd @ rd) ** 2 * m / (m - 1))
    assert got["theta"] == pytest.approx(theta, rel=1e-6)
    assert got["se"] == pytest.approx(se, rel=1e-6)


def test_garch_grid_equals_a_plain_loop(spark):
    g = np.random.default_rng(8)
    r = g.normal(size=60) * 0.01
    df = spark.createDataFrame([("x", f"d{i // 20}", i % 20, float(v)) for i, v in enumerate(r)], "asset string, day string, bar int, r double")
    got = models.garch_grid(df, ["asset"], "day", "bar", "r", [0.05, 0.2], [0.5, 0.7], 5).collect()[0]
    v, best = r.var(), None
    for a in (0.05, 0.2):
        for b in (0.5, 0.7):
            h, nll = v, 0.0
            for e in r:
                nll += 0.5 * (math.log(h) + e * e / h)
                h = v * (1 - a - b) + a * e * e + b * h
            best = min(best or (1e9,), (nll, a, b, h))
    assert (got["nll"], got["alpha"], got["beta"], got["next_variance"]) == pytest.approx(best)


def test_confidence_set_drops_a_bad_model(spark):
    g = np.random.default_rng(9)
    base = g.normal(size=80)
    rows = [("f", m, i, float(base[i] + e + 0.05 * g.normal())) for m, e in (("good", 0.0), ("twin", 0.0), ("bad", 1.0)) for i in range(80)]
    df = spark.createDataFrame(rows, "family string, model string, idx bigint, value double")
    out = {r["model"]: r["survives"] for r in inference.model_confidence_set(df, ["family"], "model", 5, 100, 650).collect()}
    assert out["bad"] is False and (out["good"] or out["twin"])


def test_block_bootstrap_interval_covers_the_mean(spark):
    g = np.random.default_rng(10)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(g.normal(size=60))], "s string, idx bigint, value double")
    r = inference.block_bootstrap(df, ["s"], 5, 300, 650).collect()[0]
    assert r["ci_low"] < r["estimate"] < r["ci_high"] and 0 < r["p_value"] <= 1


def test_double_ml_fills_missing_controls_by_fold(spark):
    g = np.random.default_rng(11)
    n, sessions = 500, 20
    s = np.sort(g.integers(0, sessions, n))
    x = np.column_stack([g.normal(size=n), g.gamma(2.0, size=n)])
    d = x @ np.array([0.5, 0.2]) + g.normal(size=n)
    y = x @ np.array([1.0, -1.0]) + 0.7 * d + g.normal(size=n)
    x[g.random(n) < 0.2, 1] = np.nan
    p = pd.DataFrame({"k": "a", "session_date": pd.to_datetime("2024-01-01") + pd.to_timedelta(s, unit="D"), "y": y, "d": d, "x0": x[:, 0], "x1": x[:, 1]})
    df = spark.createDataFrame(p).withColumn("session_date", F.to_date("session_date"))
    got = regression.double_ml(df, ["k"], F.col("y"), {"d": F.col("d")}, [F.col("x0"), F.col("x1")], 4).collect()[0]
    rank = np.unique(s, return_inverse=True)[1]
    ry, rd = np.zeros(n), np.zeros(n)
    for chunk in np.array_split(np.unique(rank), 4):
        a, b = chunk[0], chunk[-1]
        te, tr = (rank >= a) & (rank <= b), (rank < a - 1) | (rank > b + 1)
        filled = np.where(np.isnan(x), np.nanmedian(x[tr], axis=0), x)
        z = np.column_stack([np.ones(n), (filled - filled[tr].mean(axis=0)) / filled[tr].std(axis=0), np.isnan(x[:, 1])])
        for v, out in ((y, ry), (d, rd)):
            w = np.linalg.solve(z[tr].T @ z[tr] + 1e-6 * np.eye(4), z[tr].T @ v[tr])
            out[te] = v[te] - z[te] @ w
    theta = (rd @ ry) / (rd @ rd)
    u = np.array([(rd * (ry - theta * rd))[rank == c].sum() for c in np.unique(rank)])
    assert got["rows"] == n and got["clusters"] == u.size
    assert got["theta"] == pytest.approx(theta, rel=1e-6)
    assert got["se"] == pytest.approx(math.sqrt((u @ u) / (rd @ rd) ** 2 * u.size / (u.size - 1)), rel=1e-6)
    gone = regression.double_ml(df.withColumn("x1", F.lit(None).cast("double")), ["k"], F.col("y"), {"d": F.col("d")}, [F.col("x0"), F.col("x1")], 4)
    assert gone.count() == 0
