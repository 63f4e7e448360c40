"""Boosting over cells of rows with the same bins."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import models as M


def frame(spark, n=20_000):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 10, n) / 10.0, rng.integers(0, 12, n) / 12.0
    t = np.exp(a - b * b + 0.1 * rng.normal(size=n))
    return a, b, t, spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, t)], "a double, b double, target double").repartition(3)


def test_rows_with_the_same_bins_are_one_cell(spark):
    a, b, t, df = frame(spark)
    edges = B.bin_edges(df, ["a", "b"])
    got = B._packed(df, F.col("target"), ("a", "b"), edges).collect()
    facts = np.concatenate([d[1] for d in got], axis=1)
    assert sum(len(d[0]) for d in got) == 120 == facts.shape[1]
    assert facts[0].sum() == len(t) and np.isclose(facts[1].sum(), t.sum()) and np.isclose((facts[0] * facts[2]).sum(), np.log(t).sum())
    assert np.isclose((facts[3] + facts[0] * facts[2] ** 2).sum(), (np.log(t) ** 2).sum())


def test_forecasts_and_smearing_follow_the_trees(spark, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 7)
    a, b, t, df = frame(spark)
    out, fit = M.boosted_ensembles(df, {"l": B.Ensemble("log", ("a", "b")), "q": B.Ensemble("qlike", ("a",))}, F.lit(True), rounds=5, leaves=6)
    bins = B.binned([a, b], fit.edges)
    z = {n: fit.start[n] + sum(k.scores(bins) for k in fit.trees[n]) for n in ("l", "q")}
    assert np.isclose(fit.residual_variance("l"), np.var(np.log(t) - z["l"]))
    want = {(x, y): (p, q) for x, y, p, q in zip(a, b, np.exp(z["l"] + 0.5 * np.var(np.log(t) - z["l"])), np.exp(z["q"]))}
    for r in out.dropDuplicates(["a", "b"]).collect():
        assert np.allclose((r.forecasts.l, r.forecasts.q), want[r.a, r.b])


def test_the_child_with_fewer_rows_is_summed(monkeypatch):
    """A tree costs its root and at most half of the rows of every node that is split."""
    rng = np.random.default_rng(5)
    bins = np.asfortranarray(rng.integers(0, 40, (5000, 2)).astype(np.uint8))
    t = np.exp(bins[:, 0] / 20 - (bins[:, 1] > 35) + 0.1 * rng.normal(size=5000))
    facts = np.stack([np.ones(5000), t, np.log(t), np.zeros(5000)])
    seen, plain = [], B.Placed.histogram

    def histogram(self, node):
        n = len(self.bins) if self.rows[node] is None else len(self.rows[node])
        beside = [len(self.rows[k]) for _, _, _, a, b in self.last for k in ((b,) if node == a else (a,) if node == b else ())]
        seen.append(all(n <= k for k in beside))
        return plain(self, node)

    def follow(self, splits, plain=B.Placed.follow):
        self.last = splits[self.split :]
        plain(self, splits)

    monkeypatch.setattr(B.Placed, "histogram", histogram)
    monkeypatch.setattr(B.Placed, "follow", follow)
    monkeypatch.setattr(B.Placed, "last", [], raising=False)
    held = B.Held((bins, facts, np.zeros((1, 5000))), ["qlike"], 41)
    B.boost(held, 5000, ["qlike"], [np.ones(2, bool)], [np.array([1, 0])], 2, 8, float("inf"), 0.1, 20, 1e-3)
    assert len(seen) > 8 and all(seen)


def test_tables_of_a_forest_follow_its_splits():
    """Trees of one leaf, of a few and of more than a table holds."""
    rng = np.random.default_rng(6)
    bins = np.asfortranarray(rng.integers(0, 256, (40_000, 3)).astype(np.uint8))

    def grown(splits):
        feature, edge, left, right, leaves = [0], [255], [0], [0], [0]
        for _ in range(splits):
            k = leaves.pop(rng.integers(len(leaves)))
            feature[k], edge[k], left[k], right[k] = rng.integers(3), rng.integers(255), len(left), len(left) + 1
            for _ in range(2):
                leaves.append(len(left))
                feature, edge, left, right = feature + [0], edge + [255], left + [len(left)], right + [len(right)]
        return B.Tree(*(np.array(x, np.int32) for x in (feature, edge, left, right)), rng.normal(size=len(left)), splits)

    trees = [grown(k) for k in (0, 1, 30, 63, 90)]
    for t in trees:
        assert np.array_equal(t.scores(bins), B.Forest._walk(t, bins))
    assert np.allclose(B.Forest(trees).scores(bins), sum(B.Forest._walk(t, bins) for t in trees), atol=1e-12)


def test_sums_of_cells_are_those_of_rows():
    """Gradient, Hessian and loss of a cell from one sum and its rows, exponents held or not."""
    rng = np.random.default_rng(7)
    t, cell = np.exp(rng.normal(size=3000)), rng.integers(0, 30, 3000)
    n = np.bincount(cell).astype(float)
    log = np.bincount(cell, np.log(t)) / n
    facts = np.stack([n, np.bincount(cell, t), log, np.bincount(cell, (np.log(t) - log[cell]) ** 2)])
    for z in (rng.normal(size=30), np.full(30, -40.0), np.full(30, 40.0)):
        for loss in B.LOSSES:
            w, (total, bias) = B._cell_sums(loss, facts, z)
            g, h = B._newton(loss, np.stack([w, n])[None])
            want_g, want_h = B.gradients(loss, t, z[cell])
            assert np.allclose(g[0], np.bincount(cell, want_g), rtol=1e-10, atol=1e-10) and np.allclose(h[0], np.bincount(cell, want_h), rtol=1e-10)
            assert np.isclose(total, B.loss_sum(loss, t, z[cell]), rtol=1e-10) and np.isclose(bias, (z[cell] - np.log(t)).sum(), rtol=1e-10)


def test_boxes_of_a_grid_give_what_cells_give():
    """Histograms, losses, trees and scores of cells in an array equal those of listed cells, for axes of any order of length."""
    rng = np.random.default_rng(8)
    bins = np.unique(np.stack([rng.integers(1, 60, 9000), rng.integers(0, 5, 9000), rng.integers(3, 30, 9000)], axis=1).astype(np.uint8), axis=0)
    rng.shuffle(bins)
    n = rng.integers(1, 40, len(bins)).astype(float)
    log = bins[:, 0] / 30 - (bins[:, 2] > 20) * bins[:, 1] / 4 + 0.1 * rng.normal(size=len(bins))
    part = np.asfortranarray(bins), np.stack([n, n * np.exp(log), log, 0.01 * n]), rng.normal(size=(2, len(bins)))
    splits = [[(0, 0, 25, 1, 2), (2, 2, 12, 3, 4), (4, 1, 2, 5, 6)], [(0, 2, 20, 1, 2)]]
    asked = [part[2], [[0], [0]], [[1, 3, 5, 6], [2]]]
    got = []
    for rows in (B.Held(part, list(B.LOSSES), 64), B.Grid(part, list(B.LOSSES), 64)):
        *first, loss = rows.ask([[], []], asked[1])
        got.append([*first, loss, *rows.ask(splits, asked[2])[:-1]])
    assert all(a.shape == b.shape and np.allclose(a, b, rtol=1e-11, atol=1e-9) for a, b in zip(*got))
    shapes = [np.ones(3, bool)] * 2, [np.array([1, 0, 0]), np.zeros(3, int)]
    fits = [B.boost(k(part, list(B.LOSSES), 64), int(n.sum()), list(B.LOSSES), *shapes, 6, 12, float("inf"), 0.1, 20, 1e-3) for k in (B.Held, B.Grid)]
    for one, other in zip(*(f[0] for f in fits)):
        assert len(one) == 6 and all(np.allclose(a, b) for s, t in zip(one, other) for a, b in zip(s, t))
    assert np.allclose(fits[0][1], fits[1][1]) and np.allclose(fits[0][3], fits[1][3])


def test_a_fit_over_few_features_sums_boxes(spark, monkeypatch):
    """Cells that fill their bins are not looked up one by one as a tree grows; those that do not are."""
    *_, df = frame(spark, 4000)
    plain = B.boost
    monkeypatch.setattr(B, "boost", lambda rows, *a: (*plain(rows, *a)[:2], [[type(rows) is B.Grid]], [0.0]))
    e = {"q": B.Ensemble("qlike", ("a",))}
    for most in (B.DENSE, 0):
        monkeypatch.setattr(B, "DENSE", most)
        assert B.fit(df, e, F.col("target"), F.lit(True), rounds=2, leaves=4).gains["q"] == {"a": float(most > 0)}


def test_forecasts_are_looked_up_where_bins_are_few(spark, monkeypatch):
    """A table over all bins gives what scoring of cells gives, missing values and those beyond the training rows' too."""
    *_, df = frame(spark, 4000)
    e = {"l": B.Ensemble("log", ("a", "b")), "q": B.Ensemble("qlike", ("b",))}
    fit = B.fit(df, e, F.col("target"), F.lit(True), rounds=4, leaves=6)
    odd = df.limit(50).unionByName(spark.createDataFrame([(None, 0.5, 1.0), (9.0, -9.0, 1.0), (float("nan"), None, 1.0)], df.schema)).coalesce(1).cache()
    looked = [tuple(r.raw) for r in fit.forecasts(odd).collect()]
    monkeypatch.setattr(B, "TABLE", 0)
    assert looked == [tuple(r.raw) for r in fit.forecasts(odd).collect()] and len(looked) == 53
    shape = np.array([len(x) + 2 for x in fit.edges])
    bins = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), axis=-1).reshape(-1, 2).astype(np.uint8)
    for n in e:
        assert np.array_equal(B._table(fit.trees[n], shape).ravel(), B.Forest(fit.trees[n]).scores(bins))
