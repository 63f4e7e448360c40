"""Wide designs, multiplied rows and the ladder's own rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import regression as R
from tidemark.plans import q_mod as Q


def frame(spark, n=600):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(float(a), float(b), float(np.exp(0.3 * a + 0.1 * e))) for a, b, e in rng.normal(size=(n, 3))], "a double, b double, target double").repartition(3)


def test_array_moments_equal_moments(spark):
    df = frame(spark).unionByName(spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, target double"))
    x = [F.lit(1.0), F.col("a"), F.col("b")]
    want = R.moments(df, [], x, [F.log("target")]).collect()[0]
    got = R.array_moments(df.select(F.array(*x).alias("x"), F.log("target").alias("y")), "x", 3, "y").collect()[0]
    assert got.asDict().keys() == want.asDict().keys() and all(np.isclose(got[c], want[c]) for c in want.asDict())


def test_glm_of_multiplied_rows(spark):
    df = frame(spark)
    each = F.array(F.struct(F.lit("g").alias("f"), F.lit(2.0).alias("p"), F.lit(1.0).alias("m")), F.struct(F.lit("t").alias("f"), F.lit(1.7).alias("p"), F.lit(0.0).alias("m")))
    x = [F.lit(1.0), F.col("a"), F.col("b") * F.col("m")]
    a = R.positive_glm(df, ["f", "p"], x, F.col("target"), F.lit(True), F.col("p"), each=each).collect()
    b = R.positive_glm(df.withColumn("_o", F.explode(each)).select("a", "b", "target", "_o.*"), ["f", "p"], x, F.col("target"), F.lit(True), F.col("p")).collect()
    a, b = ({r.f: r for r in rows} for rows in (a, b))
    assert a.keys() == b.keys() == {"g", "t"} and all(np.allclose(a[k].coef, b[k].coef) and a[k].train_rows == 600 for k in a)


def test_contrasts_shuffle_no_rows(spark):
    names = [f"ridge__{n}__{k}" for n in Q.SETS for k in Q.KINDS]
    rows = spark.createDataFrame([(1, *[float(i) for i in range(8)])], "session_date int, " + ", ".join(f"{n} double" for n in names))
    out = Q.contrasts(rows, ["ridge"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.kind, r.contrast): (r.lb, r.lw) for r in out.collect()}
    assert len(got) == 8 and got["raw", "both"] == (0.0, 6.0) and got["recalibrated", "trades_after_quotes"] == (3.0, 7.0)
