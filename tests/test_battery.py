"""Several responses of double ML on the same moments."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import regression as R


def frame(spark, n=3000):
    rng = np.random.default_rng(8)
    x, e, day, k = rng.normal(size=n), rng.normal(size=(3, n)), rng.integers(0, 40, n), rng.integers(0, 2, n)
    d = 0.5 * x + e[0]
    rows = [("ab"[k[i]], int(day[i]), float(d[i] + x[i] + e[1][i]), None if i % 7 == 0 else float(d[i] - x[i] + 0.3 * e[2][i]), float(d[i]), None if i % 5 == 0 else float(x[i])) for i in range(n)]
    rows += [("a", None, 1.0, 1.0, 1.0, 1.0), ("b", 3, None, None, 1.0, 1.0), ("b", 3, 1.0, 1.0, None, 1.0)]
    return spark.createDataFrame(rows, "k string, session_date int, y double, z double, d double, x double").repartition(3)


def test_responses_equal_single_fits(spark):
    df = frame(spark)
    fit = lambda y: R.double_ml(df, ["k"], y, {"d": F.col("d")}, [F.col("x")], 4)
    both = {(r.k, r.response): r for r in fit({"y": F.col("y"), "z": F.col("z")}).collect()}
    assert len(both) == 4 and both["a", "z"].rows < both["a", "y"].rows
    for name in "yz":
        for r in fit(F.col(name)).collect():
            got = both[r.k, name]
            assert (got.rows, got.clusters, got.treatment) == (r.rows, r.clusters, r.treatment) == (df.where(F.col(name).isNotNull() & F.col("d").isNotNull() & F.col("session_date").isNotNull()).where(F.col("k") == r.k).count(), 40, "d")
            assert np.allclose([got.theta, got.se, got.joint_wald], [r.theta, r.se, r.joint_wald], rtol=1e-9)


def test_no_row_is_joined_to_coefficients(spark, monkeypatch):
    """Residuals come from session sums: what is written between steps, rows aside, is counted in sessions."""
    from tidemark.sources import results

    sizes, write = [], results.materialise
    monkeypatch.setattr(results, "materialise", lambda df: (out := write(df), sizes.append(out.count()))[0])
    df = frame(spark)
    R.double_ml(df, ["k"], {"y": F.col("y"), "z": F.col("z")}, {"d": F.col("d")}, [F.col("x")], 4).collect()
    assert sorted(sizes)[-1] <= df.count() and sorted(sizes)[-2] <= 2 * 2 * 40
