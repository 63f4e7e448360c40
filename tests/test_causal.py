"""Fits that must not see test rows, quote ties, the confidence set, and streams in several files."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import inference, joins, models
from tidemark.streaming import run, windows

FOLDS = [(1, "2024-01-20", "2024-01-21", "2024-01-31")]


def panel(spark, disturb=False):
    rng = random.Random(7)
    rows = []
    for day in range(1, 32):
        for k in range(8):
            x1, x2 = rng.gauss(0, 1), rng.gauss(5, 3)
            y = float(np.exp(0.3 * x1 - 0.1 * x2 + rng.gauss(0, 0.2)))
            other = disturb and day > 20 and k > 3
            rows.append((f"{day}-{k}", "ab"[k % 2], dt.date(2024, 1, day), day * 86_400_000_000, x1 * (50 if other else 1), x2 + (900 if other else 0), y * (1000 if other else 1)))
    return spark.createDataFrame(rows, "origin_id string, asset string, session_date date, origin_us bigint, x1 double, x2 double, target double")


def forecasts(df):
    return {r.origin_id: r.forecast for r in df.select("origin_id", "forecast").collect() if int(r.origin_id.split("-")[1]) <= 3}


def test_tuned_fits_ignore_test_rows(spark):
    x = [F.lit(1.0), F.col("s_x1"), F.col("s_x2")]

    def tuned(df):
        parts = models.scale_by_fit(models.split_folds(df, FOLDS, 5, 86_400_000_000), ["fold"], ["x1", "x2"])
        return forecasts(models.tune_ridge(parts, ["fold"], x, "target", [0.1, 10.0]))

    before, after = tuned(panel(spark)), tuned(panel(spark, True))
    assert len(before) == 44 and all(abs(before[k] - after[k]) < 1e-9 for k in before)


def test_left_out_assets_ignore_test_rows(spark):
    training = F.col("session_date") <= F.lit("2024-01-20").cast("date")
    fit = lambda df: forecasts(models.leave_one_out(df, "asset", [F.lit(1.0), F.col("x1")], "target", training))
    before, after = fit(panel(spark)), fit(panel(spark, True))
    assert len(before) == 124 and all(abs(before[k] - after[k]) < 1e-9 for k in before)


def test_boosted_level_carries_the_spread(spark):
    df = panel(spark)
    training = F.lit(True)
    out, _ = models.boosted(df, ["x1", "x2"], training, rounds=3, depth=2)
    rows = out.select("target", "forecast").toPandas()
    logs = np.log(rows.target) - np.log(rows.forecast)
    assert abs(logs.mean() + 0.5 * logs.var(ddof=0)) < 1e-6


def test_last_quote_of_equal_times_is_the_last_in_sequence(spark):
    q = spark.createDataFrame([("a", 100, 1, 9.0, 10.0), ("a", 100, 2, None, None), ("a", 50, 3, 1.0, 2.0)], "asset string, quote_us bigint, id bigint, bid double, ask double")
    o = spark.createDataFrame([("o", "a", 150)], "origin_id string, asset string, origin_us bigint")
    got = joins.last_quote(o, q, ["asset"], 0, ["bid", "ask"]).first()
    assert got.quote_us == 100 and got.bid is None and got.ask is None


def test_confidence_set_equals_plain_elimination(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(1, 0.3, 60)
    losses = {m: base + shift + rng.normal(0, 0.1, 60) for m, shift in (("a", 0.0), ("b", 0.01), ("c", 0.08), ("d", 0.5))}
    rows = [("f", m, i, float(v[i])) for m, v in losses.items() for i in range(60)]
    df = spark.createDataFrame(rows, "family string, model string, idx bigint, value double")
    got = {r.model: (round(r.mcs_p, 9), r.survives) for r in inference.model_confidence_set(df, ["family"], "model", 5, 150, 650).collect()}
    drawn = inference.block_resample(df, ["family", "model"], {"s": F.col("value")}, 5, 150, 650)
    boot = drawn.select("model", "rep", (F.col("s") / F.col("_len")).alias("m")).toPandas().pivot(index="rep", columns="model", values="m")
    mean = pd.Series({m: v.mean() for m, v in losses.items()})
    names, p, want = sorted(losses), 0.0, {}
    while names:
        excess = mean[names] - mean[names].mean()
        noise = boot[names].sub(boot[names].mean(axis=1), axis=0) - excess
        t = excess / noise.std(ddof=1) if len(names) > 1 else excess * 0
        p = max(p, ((noise / noise.std(ddof=1)).abs().max(axis=1).ge(t.max()).sum() + 1) / 151) if len(names) > 1 else 1.0
        if len(names) == 1 or p >= 0.1:
            want |= {m: (round(p, 9), True) for m in names}
            break
        want[t.idxmax()] = (round(p, 9), False)
        names.remove(t.idxmax())
    assert got == want and not got["d"][1]


def test_streams_over_files_with_late_rows(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 2, 12, 0, 0) + dt.timedelta(seconds=s)
    schema = "record_id string, received_at timestamp"
    # the second file holds an earlier receipt of r1, the third ends the runs, the fifth is too late
    files = [[("r1", at(60)), ("r2", at(10))], [("r1", at(0)), ("r3", at(200))], [("r9", at(4000))], [("r7", at(4100))], [("r2", at(20))], [("r8", at(9000))]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = run.files_as_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, 1)
    out = run.run_available(windows.first_receipts(stream, "10 minutes"), "append", str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.record_id, r.first_received_at, r.receipts) for r in spark.read.parquet(out).collect()}
    assert got == {("r1", at(0), 2), ("r2", at(10), 1), ("r3", at(200), 1), ("r9", at(4000), 1), ("r7", at(4100), 1)}
