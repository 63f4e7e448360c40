"""Ordered operators against brute force, with keys that dominate the data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, quantiles, ranks


def _frame(seed, n=400):
    g = np.random.default_rng(seed)
    hot = g.random(n) < 0.6
    return pd.DataFrame({"k": np.where(hot, "hot", g.choice(["a", "b"], n)), "t": g.integers(0, 300, n), "id": np.arange(n), "v": np.round(g.normal(size=n), 2)})


def test_split_lag_equals_plain_lag(spark):
    p = _frame(1)
    out = ordered.split_lag(spark.createDataFrame(p), ["k"], ["t", "id"], F.floor(F.col("t") / 20), ["v"]).toPandas()
    want = p.sort_values(["k", "t", "id"]).assign(w=lambda x: x.groupby("k")["v"].shift(1)).set_index("id")["w"]
    got = out.set_index("id")["prev_v"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)
    assert (out["prev_exists"] == out["prev_v"].notna()).all()


def test_split_running_sum_and_max(spark):
    p = _frame(2)
    df = spark.createDataFrame(p)
    s = ordered.split_running_sum(df, ["k"], ["t", "id"], F.floor(F.col("t") / 20), F.col("v"), "s")
    m = ordered.split_running_max(df, ["k"], ["t", "id"], F.floor(F.col("t") / 20), F.col("v"), "m")
    o = p.sort_values(["k", "t", "id"])
    assert np.allclose(s.toPandas().set_index("id")["s"].sort_index(), o.assign(x=o.groupby("k")["v"].cumsum()).set_index("id")["x"].sort_index())
    assert np.allclose(m.toPandas().set_index("id")["m"].sort_index(), o.assign(x=o.groupby("k")["v"].cummax()).set_index("id")["x"].sort_index())


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_equals_merge_asof(spark, strict):
    left, right = _frame(3, 200), _frame(4, 150)
    got = ordered.asof_join(
        spark.createDataFrame(left[["k", "t", "id"]]), spark.createDataFrame(right.rename(columns={"t": "rt", "id": "rid"})),
        ["k"], "t", "rt", ["v", "rid"], 25, ["rid"], strict).toPandas().sort_values("id")
    last = right.sort_values("id").groupby(["k", "t"], as_index=False).last().sort_values("t").rename(columns={"t": "rt", "id": "rid"})
    want = pd.merge_asof(left.sort_values("t")[["k", "t", "id"]], last, left_on="t", right_on="rt", by="k", allow_exact_matches=not strict).sort_values("id")
    assert np.array_equal(got["rid"].to_numpy(float), want["rid"].to_numpy(float), equal_nan=True)


def test_group_quantiles_are_exact(spark):
    g = np.random.default_rng(5)
    v = np.concatenate([g.normal(size=300), np.zeros(50), np.full(60, 7.0), -g.pareto(1.0, 200)])
    p = pd.DataFrame({"k": np.where(np.arange(v.size) % 5 == 0, "x", "y"), "v": v})
    probs = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = quantiles.group_quantiles(spark.createDataFrame(p), ["k"], "v", probs).toPandas().set_index("k")
    for k, part in p.groupby("k"):
        for n, q in probs.items():
            assert got.loc[k, n] == pytest.approx(np.quantile(part["v"], q), rel=1e-12, abs=1e-12)


def test_histograms_merge_by_addition(spark):
    p = pd.DataFrame({"part": [0, 0, 1, 1, 1], "s": [0.1, 0.2, 0.2, 5.0, -1.0]})
    df = spark.createDataFrame(p)
    parts = quantiles.latency_histogram(df, ["part"], F.col("s")).groupBy("bin").agg(F.sum("n").alias("n"))
    whole = quantiles.latency_histogram(df.withColumn("a", F.lit(1)), ["a"], F.col("s")).select("bin", "n")
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_kendall_equals_pair_counting(spark):
    g = np.random.default_rng(6)
    x, y = g.integers(0, 12, 90).astype(float), g.integers(0, 15, 90).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y, "id": np.arange(90)}))
    got = ranks.kendall(df, ["k"], "x", "y", "id").collect()[0]["kendall_tau"]
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    num = np.triu(dx * dy, 1).sum()
    n0 = 90 * 89 / 2
    tx, ty = (np.triu(dx == 0, 1)).sum(), (np.triu(dy == 0, 1)).sum()
    assert got == pytest.approx(num / np.sqrt((n0 - tx) * (n0 - ty)))
