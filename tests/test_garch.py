"""The GARCH fit against a plain filter over the whole series."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.garch import FLOOR, SCALE, garch_fit


def _series(seed, n, omega, alpha, beta):
    g = np.random.default_rng(seed)
    h, out = omega / (1 - alpha - beta), np.empty(n)
    for i in range(n):
        out[i] = math.sqrt(h) * g.normal()
        h = omega + alpha * out[i] ** 2 + beta * h
    return out


def _likelihood(r, omega, alpha, beta):
    x = np.asarray(r) * SCALE
    w = omega * SCALE**2
    h, total = w / max(1 - alpha - beta, 1e-6), 0.0
    for v in x:
        f = max(h, FLOOR)
        total += 0.5 * (math.log(f) + v * v / f)
        h = w + alpha * v * v + beta * h
    return total, h / SCALE**2


SCHEMA = "asset string, day string, bar bigint, r double, u string"


def test_fit_is_the_plain_optimum(spark):
    g = np.random.default_rng(3)
    rows, whole = [], {}
    for name, n, theta in (("hot", 6000, (2e-8, 0.08, 0.9)), ("b", 1500, (4e-8, 0.15, 0.7))):
        r = whole[name] = _series(len(name), n, *theta)
        cuts = np.sort(g.choice(np.arange(1, n), n // 60, replace=False))
        for day, part in enumerate(np.split(r, cuts)):
            rows += [(name, f"{day:05d}", i, float(v), "clash") for i, v in enumerate(part)]
    out = garch_fit(spark.createDataFrame(rows, SCHEMA), ["asset"], "day", "bar", "r", 10).toPandas().set_index("asset")
    for name, r in whole.items():
        f = out.loc[name]
        at, after = _likelihood(r, f["omega"], f["alpha"], f["beta"])
        assert f["status"] == "converged" and f["observations"] == len(r)
        assert f["nll"] == pytest.approx(at, rel=1e-9) and f["next_variance"] == pytest.approx(after, rel=1e-9)
        for k in range(3):
            for s in (0.99, 1.01):
                theta = [f["omega"], f["alpha"], f["beta"]]
                theta[k] *= s
                assert _likelihood(r, *theta)[0] >= at - 1e-9 * abs(at)
    hot = out.loc["hot"]
    assert at <= _likelihood(whole["b"], 4e-8, 0.15, 0.7)[0]
    assert abs(hot["alpha"] - 0.08) < 0.03 and abs(hot["beta"] - 0.9) < 0.05
    p, level = hot["alpha"] + hot["beta"], hot["variance"]
    assert hot["forecast"] == pytest.approx(sum(level + p**i * (hot["next_variance"] - level) for i in range(10)), rel=1e-9)


def test_keys_that_cannot_be_fitted(spark):
    rows = [("short", "d1", i, 0.001 * i, None) for i in range(99)] + [("flat", "d1", i, 0.0, None) for i in range(200)]
    rows += [("short", "d2", 0, None, None), ("short", "d2", 1, float("nan"), None), ("short", None, 1, 0.5, None)]
    out = garch_fit(spark.createDataFrame(rows, SCHEMA), ["asset"], "day", "bar", "r", 10).toPandas().set_index("asset")
    assert out["status"].to_dict() == {"short": "short", "flat": "flat"} and out["observations"].to_dict() == {"short": 99, "flat": 200}
    assert out[["omega", "alpha", "beta", "forecast"]].isna().all().all()
    assert garch_fit(spark.createDataFrame([], SCHEMA), ["asset"], "day", "bar", "r", 10).count() == 0


def test_repeated_rows_and_white_noise_end(spark):
    g = np.random.default_rng(8)
    rows = [("w", f"{d:03d}", i // 2, float(v), None) for d in range(30) for i, v in enumerate(np.repeat(g.normal(0, 1e-3, 10), 2))]
    f = garch_fit(spark.createDataFrame(rows, SCHEMA), ["asset"], "day", "bar", "r", 5).toPandas().iloc[0]
    assert f["status"] in ("converged", "stalled", "passes") and f["alpha"] + f["beta"] < 0.999 and np.isfinite(f["forecast"])
    plain = pd.DataFrame(rows, columns=["a", "d", "b", "r", "u"]).sort_values(["d", "b", "r"])["r"]
    assert f["nll"] == pytest.approx(_likelihood(plain, f["omega"], f["alpha"], f["beta"])[0], rel=1e-9)
