"""Leak, window-edge, grid and guard tests."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import time as T
from tidemark.operators import flow, grid, joins, panes, quality

STEP = 300_000_000
DAY = dt.date(2024, 1, 3)
BASE = 1_704_240_000_000_000


def tape(spark, rows):
    cols = ["id", "executed_us", "created_us", "premium"]
    p = pd.DataFrame(rows, columns=cols)
    return spark.createDataFrame(p).select(
        "*", F.lit("x").alias("asset"), F.lit(DAY).alias("session_date"), (F.col("id") % 3).alias("contract"), (F.lit(100.0) + F.col("id") % 3).alias("strike"),
        F.lit(DAY).alias("expiry"), F.lit("call").alias("option_type"), F.lit("ask_side").alias("tags"), F.lit("").alias("flags"))


def origins(spark, ks):
    return spark.createDataFrame([(f"o{k}", "x", DAY, k * 5, BASE + k * STEP) for k in ks], "origin_id string, asset string, session_date date, minute int, origin_us bigint")


ROWS = [(i, BASE + i * 40_000_000, BASE + i * 40_000_000 + 1_000_000, 1.0 + i) for i in range(30)]


def test_rows_published_after_the_cutoff_change_nothing(spark):
    o = origins(spark, [2, 3, 4])
    before = flow.activity(tape(spark, ROWS), o, STEP, 2, [60]).orderBy("origin_id").collect()
    cutoff = BASE + 4 * STEP - 60_000_000
    later = ROWS + [(100 + i, BASE + 2 * STEP + i, cutoff + 1 + i, 999.0) for i in range(5)] + [(200, cutoff + 5, cutoff + 6, 5.0)]
    after = flow.activity(tape(spark, later), o, STEP, 2, [60]).orderBy("origin_id").collect()
    assert before == after


def test_half_open_window_edges(spark):
    end = BASE + 4 * STEP
    rows = [(1, end - STEP, end, 1.0), (2, end - STEP - 1, end - 10, 1.0), (3, end, end, 1.0), (4, end - 1, end + 1, 1.0), (5, end - 1, end, 1.0)]
    got = panes.window_rows(tape(spark, rows), origins(spark, [4]), STEP, 1, 0, True)
    assert sorted(r["id"] for r in got.collect()) == [1, 5]


def test_activity_of_an_empty_window_is_zero(spark):
    row = flow.activity(tape(spark, ROWS[:1]), origins(spark, [90]), STEP, 1, [60]).collect()[0]
    assert (row["trades"], row["contracts"], row["total_premium"], row["ask_share"]) == (0, 0, 0.0, 0.0)


def test_snapshot_is_closed_at_both_ends(spark):
    cut = BASE + 6 * STEP - 120_000_000
    rows = [(3, 0, cut, 1.0), (6, 0, cut - 2 * STEP, 1.0), (9, 0, cut - 2 * STEP - 1, 1.0), (4, 0, cut + 1, 1.0), (1, 0, cut - 5, 1.0)]
    snap = joins.contract_snapshot(tape(spark, rows), STEP, 2, 120, ["premium"]).where(F.col("origin_us") == BASE + 6 * STEP)
    got = {r["contract"]: (r["id"], r["records"]) for r in snap.collect()}
    assert got == {0: (3, 2), 1: (1, 1)}


def test_counting_windows_tile_the_session(spark):
    t = tape(spark, ROWS)
    out = flow.counting_windows(t, origins(spark, [1, 2, 3, 4, 5, 6]), STEP, 120).collect()
    assert sum(r["trades"] for r in out) == t.count() - sum(1 for r in ROWS if r[2] > BASE + 6 * STEP - 120_000_000)


def test_grid_fills_forward_only(spark):
    cal = spark.createDataFrame([(DAY, 5, BASE), (dt.date(2024, 1, 4), 0, BASE)], "session_date date, minutes bigint, open_us bigint")
    bars = spark.createDataFrame(
        [("x", DAY, 1, 10.0, 11.0, 9.0, 10.5, 3.0), ("x", DAY, 3, 12.0, 12.0, 12.0, 12.0, 1.0), ("x", dt.date(2024, 1, 4), 0, 1.0, 1.0, 1.0, 1.0, 1.0)],
        "asset string, session_date date, bar bigint, open double, high double, low double, close double, volume double")
    g = grid.dense_grid(bars, cal, ["x"]).orderBy("bar").collect()
    assert [r["close"] for r in g] == [None, 10.5, 10.5, 12.0, 12.0]
    assert [r["open"] for r in g] == [None, 10.0, None, 12.0, None]
    assert [r["volume"] for r in g] == [0.0, 3.0, 0.0, 1.0, 0.0]
    assert [r["valid"] for r in g] == [False, True, True, True, True]
    assert g[0]["fill_share"] == pytest.approx(0.6)


@pytest.mark.parametrize("text,utc", [("2024-03-08 09:30:00", "2024-03-08 14:30:00"), ("2024-03-11 09:30:00", "2024-03-11 13:30:00"), ("2024-11-04 09:30:00", "2024-11-04 14:30:00")])
def test_new_york_clock_change(spark, text, utc):
    got = spark.range(1).select(T.parse_wall(F.lit(text), "yyyy-MM-dd HH:mm:ss", T.NEW_YORK).alias("u")).collect()[0]["u"]
    assert got == int(pd.Timestamp(utc, tz="UTC").timestamp()) * 1_000_000


def test_guards_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        quality.assert_unique_key(df, ["k"])
    with pytest.raises(ValueError):
        quality.forbid_columns(spark.createDataFrame([(1,)], "rv30_x int"))
    rows = spark.createDataFrame([(DAY,)], "session_date date")
    roles = spark.createDataFrame([(DAY, "C")], "session_date date, role string")
    with pytest.raises(Exception, match="sealed"):
        quality.refuse_sealed(rows, roles, "C").collect()
    bars = spark.createDataFrame([("x", DAY, 0, 1.0, "a"), ("x", DAY, 0, 2.0, "b")], "asset string, session_date date, bar int, close double, source string")
    with pytest.raises(Exception, match="disagree"):
        joins.deduplicate_sources(bars).collect()


def test_sealed_findings_tell_what_the_guard_refuses(spark):
    rows = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-02-01"), ("a", "2024-02-01"), ("b", "2024-01-01"), ("c", "2024-03-01"), ("d", None)], "asset string, day string").selectExpr("asset", "cast(day as date) session_date")
    roles = spark.createDataFrame([("2024-01-01", "D"), ("2024-02-01", "C")], "day string, role string").selectExpr("cast(day as date) session_date", "role")
    got = {r.asset: (r.rows, r.sealed_rows, r.rows_without_role, str(r.first_sealed), r.sealed_days, r.verdict) for r in quality.sealed_findings(rows, roles, "C", ["asset"]).collect()}
    assert got == {"a": (3, 2, 0, "2024-02-01", 1, "REFUSED"), "b": (1, 0, 0, "None", 0, "PASS"), "c": (1, 0, 1, "None", 0, "UNASSIGNED"), "d": (1, 0, 1, "None", 0, "UNASSIGNED")}
