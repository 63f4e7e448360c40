"""Folds of any size: their rows stay where they are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import regression as R

FOLDS = [(1, "2024-01-10", "2024-01-11", "2024-01-14"), (2, "2024-01-14", "2024-01-15", "2024-01-18")]


def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), int(k), float(x), float(np.exp(0.5 * x + 0.1 * e))) for k, (d, x, e) in enumerate(zip(rng.integers(0, 18, 2000), rng.normal(size=2000), rng.normal(size=2000)))]
    df = spark.createDataFrame(rows, "d int, origin_id int, x double, target double")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    return df.withColumns({"session_date": day, "origin_us": F.unix_micros(day.cast("timestamp"))})


@pytest.fixture()
def unhinted(spark):
    """Without hints every join would shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def shuffles_rows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_no_fold_is_shuffled_into_one_task(unhinted):
    parts = M.scale_by_fit(M.split_folds(frame(unhinted), FOLDS, 3, 86_400_000_000), ["fold"], ["x"])
    assert not shuffles_rows(parts)
    assert {r["part"] for r in parts.select("part").distinct().collect()} >= {"fit", "validate", "test"}


def test_forecasts_of_tuned_fits(unhinted):
    parts = M.scale_by_fit(M.split_folds(frame(unhinted), FOLDS, 3, 86_400_000_000), ["fold"], ["x"])
    x = [F.lit(1.0), F.col("s_x")]
    whole = M.tune_ridge(parts, ["fold"], x, "target", [0.1, 10.0])
    fits = M.tuned_fits(parts, ["fold"], x, "target", [0.1, 10.0])
    again = parts.where("part = 'test'").join(F.broadcast(fits.select("fold", "coef", "smearing")), "fold").withColumn("f", R.predict_level(x))
    a = {(r.fold, r.origin_id): r.forecast for r in whole.collect()}
    b = {(r.fold, r.origin_id): r.f for r in again.collect()}
    assert a and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_a_stage_of_folds_holds_what_is_read_later(spark, monkeypatch):
    """Rows stand once per fold, so neither purged rows nor columns that no pass reads are written."""
    from tidemark.plans import q_mod as Q

    written = []
    monkeypatch.setattr(Q, "materialise", lambda df: written.append(df) or df)
    out = Q.tuned(spark, "/root/testdata/sf0.001")
    assert {"fold", "alpha", "validation_qlike", "target", "forecast"} <= set(out.columns)
    (stage,) = written
    assert set(stage.columns) == {"fold", "part", "target", "s_x1", "s_x2", "s_x3"}
    assert {r.part for r in stage.select("part").distinct().collect()} == {"fit", "validate", "test"}
