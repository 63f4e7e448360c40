"""Boosting, keyed GLMs and L1 paths beside plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import regression as R


def rows(n=1500, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    x[rng.random(n) < 0.1, 2] = np.nan
    t = np.exp(0.6 * x[:, 0] - 0.4 * np.abs(x[:, 1]) + 0.3 * np.isnan(x[:, 2]) + 0.2 * rng.normal(size=n))
    return x, t


def frame(spark, x, t):
    return spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(y), k % 2) for k, (r, y) in enumerate(zip(x, t))], "a double, b double, c double, target double, g int")


def plain_tree(bins, g, h, leaves, min_rows, allowed, rate):
    """Leaf-wise growth, one split at a time, over masks of rows."""
    nodes = {0: np.ones(len(g), bool)}

    def best(mask):
        found = (-np.inf,)
        for f in allowed:
            for b in range(int(bins[:, f].max()) + 1):
                lo, hi = mask & (bins[:, f] <= b), mask & (bins[:, f] > b)
                if min(lo.sum(), hi.sum()) < min_rows:
                    continue
                score = lambda m: g[m].sum() ** 2 / h[m].sum()
                found = max(found, (score(lo) + score(hi) - score(mask), -f, -b))
        return found

    while len(nodes) < leaves:
        top = max((best(m), -k) for k, m in nodes.items())
        if not top[0][0] > 1e-12:
            break
        (_, f, b), k = top[0], -top[1]
        m, new = nodes.pop(k), max(nodes, default=0) + 10
        nodes[new], nodes[new + 1] = m & (bins[:, -f] <= -b), m & (bins[:, -f] > -b)
    out = np.zeros(len(g))
    for m in nodes.values():
        out[m] = -rate * g[m].sum() / h[m].sum()
    return out


@pytest.mark.parametrize("small", [0, 10**6])
def test_boosting_equals_plain_trees(spark, monkeypatch, small):
    """In passes over parts, or with all rows at hand."""
    monkeypatch.setattr(B, "SMALL", small)
    monkeypatch.setattr(B, "PER_CHECKPOINT", 2)
    x, t = rows()
    ensembles = {"l": B.Ensemble("log", ("a", "b", "c")), "q": B.Ensemble("qlike", ("a", "c"))}
    edges = [np.linspace(-2, 2, 9)] * 3
    df = frame(spark, x, t).repartition(3)
    fit = B.fit(df, ensembles, F.col("target"), F.lit(True), rounds=4, leaves=6, rate=0.3, min_rows=20, edges=edges)
    bins, z = B.binned(list(x.T), edges), {n: np.full(len(t), np.log(t).mean()) for n in ensembles}
    for r in range(4):
        for n, allowed in (("l", [0, 1, 2]), ("q", [0, 2])):
            assert abs(fit.losses[n][r] - B.loss_sum(ensembles[n].loss, t, z[n]) / len(t)) < 1e-9
            z[n] = z[n] + plain_tree(bins, *B.gradients(ensembles[n].loss, t, z[n]), 6, 20, allowed, 0.3)
            assert np.allclose(sum((k.scores(bins) for k in fit.trees[n][: r + 1]), fit.start[n]), z[n], atol=1e-9)
    got = fit.forecasts(df).select("a", "b", "c", "raw").collect()
    want = {tuple(None if np.isnan(v) else v for v in row): (z["l"][k], z["q"][k]) for k, row in enumerate(x)}
    assert len(got) == len(t) and all(np.allclose((r.raw.l, r.raw.q), want[r.a, r.b, r.c], atol=1e-9) for r in got)
    assert fit.gains["q"]["a"] > 0 and set(fit.gains["q"]) == {"a", "c"}


def test_boosting_keeps_directions_and_falls(spark):
    x, t = rows()
    e = {"up": B.Ensemble("qlike", ("a", "b"), {"a": 1}), "down": B.Ensemble("log", ("a", "b"), {"a": -1})}
    fit = B.fit(frame(spark, x, t), e, F.col("target"), F.lit(True), rounds=40, leaves=8, rate=0.2)
    line = np.linspace(-3, 3, 200)
    for b in (-1.0, 0.0, 2.0, np.nan):
        bins = B.binned([line, np.full(200, b)], fit.edges)
        steps = {n: np.diff(sum((k.scores(bins) for k in fit.trees[n]), 0.0)) for n in e}
        assert (steps["up"] >= -1e-12).all() and (steps["down"] <= 1e-12).all()
    assert all(p > q for p, q in zip(fit.losses["up"], fit.losses["up"][1:]))
    with pytest.raises(ValueError):
        B.fit(frame(spark, x, t), e, F.col("target"), F.lit(False), rounds=1)


def test_boosting_depth_and_empty_splits(spark):
    x, t = rows(300)
    same = spark.createDataFrame([(1.0, 2.0)] * 50, "a double, target double")
    fit = B.fit(same, {"q": B.Ensemble("qlike", ("a",))}, F.col("target"), F.lit(True), rounds=2)
    assert [len(k.value) for k in fit.trees["q"]] == [1, 1] and abs(fit.losses["q"][-1]) < 1e-12
    flat = B.fit(frame(spark, x, t), {"l": B.Ensemble("log", ("a", "b"))}, F.col("target"), F.lit(True), rounds=3, depth=2)
    assert max(k.depth for k in flat.trees["l"]) == 2


@pytest.mark.parametrize("power", [2.0, 1.7])
def test_glm_solves_every_key(spark, power):
    x, t = rows()
    x[np.isnan(x)] = 0.0
    x[::2, 1] *= 3
    df = frame(spark, x, t)
    design = [F.lit(1.0), F.col("a"), F.col("b"), F.col("c")]
    fit = R.positive_glm(df, ["g"], design, F.col("target"), F.lit(True), power, 1e-3)
    got = {r.g: r for r in fit.collect()}
    assert set(got) == {0, 1}
    for g, r in got.items():
        d, y, w = np.column_stack([np.ones(750), x[g::2]]), t[g::2], np.array(r.coef)
        mu = np.exp(d @ w)
        assert np.abs(d.T @ ((y - mu) * mu ** (1 - power)) / 750 - 1e-3 * w).max() < 1e-8
        assert r.score < 1e-8 and r.train_rows == 750 and 0 < r.steps < 15
    one = R.positive_glm(df, [], design, F.col("target"), F.col("g") == 0, power, 1e-3).first()
    assert np.allclose(one.coef, got[0].coef, atol=1e-8)


def test_a_glm_step_is_one_aggregate(spark, monkeypatch):
    """Newton sums and scores come from the same pass over the rows."""
    x, t = rows()
    x[np.isnan(x)] = 0.0
    df = frame(spark, x, t)
    passes, plain = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *by: passes.append(by) or plain(self, *by))
    fit = R.positive_glm(df, ["g"], [F.lit(1.0), F.col("a"), F.col("b")], F.col("target"), F.lit(True), 1.7).collect()
    assert passes == [("g",)] * (2 + max(r.steps for r in fit)) and all(r.score <= 1e-11 for r in fit)


def test_elastic_net_path_is_optimal(spark):
    x, t = rows()
    x[np.isnan(x)] = 0.0
    y = np.log(t)
    df = frame(spark, x, t)
    mom = R.moments(df, ["g"], [F.lit(1.0), F.col("a"), F.col("b"), F.col("c")], [F.log("target")])
    alphas = [0.5, 0.05, 0.001]
    got = R.elastic_net_path(mom, ["g"], 4, alphas, 0.7).collect()
    assert sorted((r.g, r.alpha) for r in got) == [(g, a) for g in (0, 1) for a in sorted(alphas)]
    for r in got:
        d, b, w = x[r.g :: 2], r.coef[0], np.array(r.coef[1:])
        e = y[r.g :: 2] - b - d @ w
        pull = d.T @ e / len(e) - r.alpha * 0.3 * w
        assert abs(e.mean()) < 1e-9
        assert all(abs(p - r.alpha * 0.7 * np.sign(v)) < 1e-8 if v else abs(p) <= r.alpha * 0.7 + 1e-9 for p, v in zip(pull, w))
    assert any((np.array(r.coef[1:]) == 0).any() for r in got)
