"""Realized measures on the dense bar grid; windows are per (asset, session), so bounded."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import floored

BIPOWER_SCALE = math.pi / 2.0
SESSION = ("asset", "session_date")


def _session():
    return Window.partitionBy(*SESSION).orderBy("bar")


def log_returns(grid: DataFrame) -> DataFrame:
    """Add ``r``, the log return from the previous slot of the session; prices must be positive."""
    w = _session()
    prev = F.lag("close").over(w)
    return grid.withColumn("r", F.when((F.col("close") > 0) & (prev > 0), F.log(F.col("close") / prev)))


def _frame(value: Column, w, h: int) -> Column:
    """Sum over a frame, null unless the frame holds ``h`` returns."""
    return F.when(F.count("r").over(w) == h, F.sum(value).over(w))


def forward_measures(returns: DataFrame, horizons: list[int]) -> DataFrame:
    """RV, bipower, jump, continuous, quarticity and semivariances of the next h returns."""
    w = _session()
    base = returns.withColumn("_adj", F.abs("r") * F.abs(F.lag("r").over(w)))
    out = {}
    for h in horizons:
        f, inner = w.rowsBetween(1, h), w.rowsBetween(2, h)
        rv = _frame(F.col("r") * F.col("r"), f, h)
        bv = F.when(F.count("r").over(f) == h, BIPOWER_SCALE * F.coalesce(F.sum("_adj").over(inner), F.lit(0.0)))
        out[f"rv_{h}"] = rv
        out[f"bv_{h}"] = bv
        out[f"rq_{h}"] = (h / 3.0) * _frame(F.pow("r", 4.0), f, h)
        out[f"up_{h}"] = _frame(F.when(F.col("r") > 0, F.col("r") * F.col("r")).otherwise(0.0), f, h)
        out[f"down_{h}"] = _frame(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0), f, h)
    df = base.withColumns(out)
    tail = {}
    for h in horizons:
        tail[f"jump_{h}"] = floored(F.col(f"rv_{h}") - F.col(f"bv_{h}"), 0.0)
    df = df.withColumns(tail)
    return df.withColumns(
        {f"cont_{h}": F.col(f"rv_{h}") - F.col(f"jump_{h}") for h in horizons}
    ).drop("_adj")


def backward_sum(value: Column, h: int) -> Column:
    """Sum of the ``h`` values that end at the slot, null where a return is missing."""
    return _frame(value, _session().rowsBetween(-(h - 1), 0), h)


def backward_rv(h: int) -> Column:
    return backward_sum(F.col("r") * F.col("r"), h)


def relative_noise(rv: Column, rq: Column, h: int, floor: float = 1e-16) -> Column:
    return F.sqrt(floored(2.0 * rq / float(h), 0.0)) / floored(rv, floor)


def single_target(grid: DataFrame, h: int) -> DataFrame:
    """RV over h returns from h+1 observed closes, or null with a reason."""
    w = _session()
    seen = F.sum(F.col("observed").cast("bigint")).over(w.rowsBetween(0, h))
    closes = F.count("close").over(w.rowsBetween(0, h))
    rv = F.sum(F.col("r") * F.col("r")).over(w.rowsBetween(1, h))
    reason = F.when(closes < h + 1, "SHORT_WINDOW").when(seen < h + 1, "MISSING_PRICE").otherwise("NONE")
    return grid.withColumn("price_count", seen).withColumn("reason", reason).withColumn(
        "target", F.when(F.col("reason") == "NONE", rv)
    )


def noise_robust_target(returns: DataFrame, h: int) -> DataFrame:
    w = _session()
    pair = returns.withColumn("_p", F.col("r") * F.lead("r").over(w))
    full = F.count("r").over(w.rowsBetween(1, h)) == h
    rv = F.sum(F.col("r") * F.col("r")).over(w.rowsBetween(1, h))
    ac = F.coalesce(F.sum("_p").over(w.rowsBetween(1, h - 1)), F.lit(0.0))
    return pair.withColumn("rv_ac1", F.when(full, rv + 2.0 * ac)).drop("_p")


def session_totals(returns: DataFrame) -> DataFrame:
    """One row per (asset, session): realized variance of the day and its slots."""
    return returns.groupBy(*SESSION).agg(
        F.sum(F.col("r") * F.col("r")).alias("day_rv"),
        F.count("r").alias("day_returns"),
        F.max("close").alias("day_high"),
    )


def day_lags(days: DataFrame, week: int = 5) -> DataFrame:
    """Previous day's RV and the mean of the prior ``week`` sessions (complete weeks only)."""
    w = Window.partitionBy("asset").orderBy("session_date")
    prior = w.rowsBetween(-week, -1)
    return days.withColumn("rv_prev_day", F.lag("day_rv").over(w)).withColumn(
        "rv_week", F.when(F.count("day_rv").over(prior) == week, F.avg("day_rv").over(prior))
    )


def parkinson(h: int) -> Column:
    """Range variance over the last h slots: sum of ln(high/low)^2 over 4 ln 2."""
    x = F.pow(F.log(F.col("high") / F.col("low")), 2.0) / (4.0 * math.log(2.0))
    w = _session().rowsBetween(-(h - 1), 0)
    return F.when(F.count("close").over(w) == h, F.sum(x).over(w))


def ewma_states(returns: DataFrame, lam: float, warmup: int, horizon: int) -> DataFrame:
    """EWMA variance forecast at each slot, one recursion per asset across sessions.

    The recursion h <- lam h + (1-lam) r^2 is linear, so a session is an affine map of the
    state that enters it: h_out = lam^n h_in + b.  Each session is reduced to (n, b); only those
    rows, one per session, are folded in order per asset; inside a session the state is again a
    weighted sum.  The cold start is the expanding mean of the first ``warmup`` squares.
    """
    w_asset = Window.partitionBy("asset").orderBy("session_date")
    w = _session().rowsBetween(Window.unboundedPreceding, 0)
    sq = F.col("r") * F.col("r")
    per = returns.where(F.col("r").isNotNull()).withColumn("_i", F.count("r").over(w))
    sizes = per.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(w_asset.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    placed = per.join(sizes, list(SESSION)).withColumn("_g", F.col("_before") + F.col("_i"))
    warm = placed.where(F.col("_g") <= warmup).groupBy("asset").agg(
        F.avg(sq).alias("_seed"), F.count(F.lit(1)).alias("_seed_n")
    )
    # Inside a session: lam^-i weights, cut to the returns after the warm-up.
    live = F.col("_g") > warmup
    k = F.greatest(F.col("_g") - F.lit(warmup), F.lit(0))
    k0 = F.greatest(F.col("_before") - F.lit(warmup), F.lit(0))
    step = F.col("_k") - F.col("_k0")
    part = (
        placed.withColumn("_k", k).withColumn("_k0", k0)
        .withColumn(
            "_acc",
            F.sum(F.when(live, (1.0 - lam) * sq * F.pow(F.lit(lam), -(step.cast("double"))))).over(w),
        )
        .withColumn("_b", F.coalesce(F.col("_acc"), F.lit(0.0)) * F.pow(F.lit(lam), step.cast("double")))
    )
    last = part.groupBy(*SESSION).agg(
        F.max_by(F.struct(F.col("_b").alias("b"), step.alias("n")), "_i").alias("_s")
    )
    order = F.sort_array(F.collect_list(F.struct("session_date", F.col("_s.b").alias("b"), F.col("_s.n").alias("n"))))
    folded = last.groupBy("asset").agg(order.alias("_days")).join(warm, "asset")
    zero = F.struct(F.col("_seed").alias("h"), F.array().cast("array<struct<session_date:date,h:double>>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        entry = F.array(F.struct(x["session_date"].alias("session_date"), acc["h"].alias("h")))
        return F.struct(
            (F.pow(F.lit(lam), x["n"].cast("double")) * acc["h"] + x["b"]).alias("h"),
            F.concat(acc["out"], entry).alias("out"),
        )

    starts = folded.select(
        "asset", F.explode(F.aggregate("_days", zero, fold)["out"]).alias("_o")
    ).select("asset", F.col("_o.session_date").alias("session_date"), F.col("_o.h").alias("_h0"))
    state = F.pow(F.lit(lam), step.cast("double")) * F.col("_h0") + F.col("_b")
    return part.join(starts, list(SESSION)).select(
        *SESSION, "bar", F.when(F.col("_g") >= warmup, horizon * state).alias("ewma")
    )
