"""Composed panels over the stand-in inputs, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import floor_div
from ..operators import grid as G
from ..operators import realized as RZ
from . import standin as X


def grid(spark: SparkSession, d: str) -> DataFrame:
    return G.dense_grid(X.bars(spark, d), X.calendar(spark, d), X.ASSETS, X.BAR_MINUTES)


def returns(spark: SparkSession, d: str) -> DataFrame:
    return RZ.log_returns(grid(spark, d))


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Price known at each slot: the previous slot's close, the opening print at slot 0."""
    w = Window.partitionBy("asset", "session_date").orderBy("bar")
    mark = F.when(F.col("bar") == 0, F.col("open")).otherwise(F.lag("close").over(w))
    return grid(spark, d).select("asset", "session_date", "bar", mark.alias("mark"))


def marked_tape(spark: SparkSession, d: str) -> DataFrame:
    """In-session trades with a positive mark price; everything else is removed."""
    t = X.tape(spark, d).withColumn(
        "bar", floor_div(F.pmod(F.col("executed_us"), F.lit(86_400_000_000)), X.SLOT_US)
    )
    return t.join(marks(spark, d), ["asset", "session_date", "bar"]).where(F.col("mark") > 0)


def chain_spot(price):
    """Squeeze a stand-in price into (90, 110), where the stand-in strikes are."""
    return F.lit(90.0) + F.lit(20.0) * price / (price + F.lit(20.0))


def chain_tape(spark: SparkSession, d: str) -> DataFrame:
    """The in-session tape with the mark on the scale of the strikes."""
    return marked_tape(spark, d).withColumn("mark", chain_spot(F.col("mark")))


def slots(spark: SparkSession, d: str) -> DataFrame:
    """Every (asset, session, bar) slot of the calendar."""
    c = X.calendar(spark, d).where(F.col("minutes") >= X.BAR_MINUTES)
    last = (F.col("minutes") / X.BAR_MINUTES).cast("bigint") - 1
    return c.withColumn("bar", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
        "asset", F.explode(F.array(*[F.lit(a) for a in X.ASSETS]))
    )


def last_session_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The last quote of each contract and session."""
    mid = (F.col("bid") + F.col("ask")) / 2.0
    row = F.struct("iv", mid.alias("mid"), "bid", "ask", "created_us")
    return (
        X.tape(spark, d)
        .groupBy("asset", "session_date", "expiry", "strike", "option_type")
        .agg(F.max_by(row, F.struct("created_us", "id")).alias("_q"))
        .select("asset", "session_date", "expiry", "strike", "option_type", "_q.*")
    )


def target_panel(spark: SparkSession, d: str, h: int) -> DataFrame:
    """Forward and backward measures with lagged day variance on every usable slot."""
    r = returns(spark, d)
    days = RZ.day_lags(RZ.session_totals(r)).select("asset", "session_date", "rv_prev_day", "rv_week")
    w = Window.partitionBy("asset", "session_date").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    f = RZ.forward_measures(r, [h]).withColumn(f"rv_back_{h}", RZ.backward_rv(h)).withColumn(
        "rv_session_to_date", F.sum(F.col("r") * F.col("r")).over(w))
    return (
        f.where(F.col(f"rv_{h}").isNotNull() & F.col(f"rv_back_{h}").isNotNull())
        .join(days, ["asset", "session_date"])
        .withColumn(f"noise_{h}", RZ.relative_noise(F.col(f"rv_{h}"), F.col(f"rq_{h}"), h))
    )


def b0_panel(spark: SparkSession, d: str) -> DataFrame:
    """Underlying feature panel: rolling measures, day lags, range, volume, clock."""
    r = returns(spark, d)
    days = RZ.day_lags(RZ.session_totals(r)).select("asset", "session_date", "rv_prev_day", "rv_week")
    w = Window.partitionBy("asset", "session_date").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    x, sq = F.col("r"), F.col("r") * F.col("r")
    f = RZ.forward_measures(r, [3]).withColumns({
        "target": F.col("rv_3"),
        "rv_back_1": RZ.backward_rv(1), "rv_back_3": RZ.backward_rv(3), "rv_back_6": RZ.backward_rv(6),
        "rq_back_6": 2.0 * RZ.backward_sum(F.pow(x, 4.0), 6),
        "rs_up_6": RZ.backward_sum(F.when(x > 0, sq).otherwise(0.0), 6),
        "rs_down_6": RZ.backward_sum(F.when(x < 0, sq).otherwise(0.0), 6),
        "rv_session_to_date": F.sum(sq).over(w),
        "ret_1": RZ.backward_sum(x, 1), "ret_6": RZ.backward_sum(x, 6),
        "parkinson_6": RZ.parkinson(6), "volume_6": RZ.backward_sum(F.col("volume"), 6),
        "dollar_volume_6": RZ.backward_sum(F.col("volume") * F.col("close"), 6),
        "minutes_since_open": F.col("bar") * X.BAR_MINUTES,
        "minutes_to_close": (F.col("slots") - F.col("bar")) * X.BAR_MINUTES,
        "day_of_week": (F.weekday("session_date") + 1).cast("bigint"),
    })
    return f.join(days, ["asset", "session_date"])


def exact_window(spark: SparkSession, d: str, h: int, control: str) -> DataFrame:
    """Features from exactly h+1 observed consecutive bars of the asset and of a control."""
    w = Window.partitionBy("asset", "session_date").orderBy("bar")
    closes, rets = w.rowsBetween(-h, 0), w.rowsBetween(-(h - 1), 0)
    e = returns(spark, d).select(
        "asset", "session_date", "bar", "close",
        F.sum(F.col("observed").cast("bigint")).over(closes).alias("have"),
        F.sum(F.col("r") * F.col("r")).over(rets).alias("rv"), F.sum("r").over(rets).alias("ret"),
        F.sum(F.col("close") * F.col("volume")).over(closes).alias("dollar"))
    c = e.where(F.col("asset") == control).select(
        "session_date", "bar", F.col("have").alias("_have"), F.col("rv").alias("control_rv"))
    j = e.join(c, ["session_date", "bar"], "left")
    reason = (
        F.when((F.col("have") < h + 1) | F.col("close").isNull(), "HISTORY_MISSING")
        .when(F.coalesce("_have", F.lit(0)) < h + 1, "CONTROL_MISSING")
        .when(~(F.col("dollar") > 0), "NO_VOLUME").otherwise("NONE"))
    ok = F.col("reason") == "NONE"
    return j.withColumn("reason", reason).select(
        "asset", "session_date", "bar", "reason", F.when(ok, F.col("rv")).alias("rv"), F.when(ok, F.col("ret")).alias("ret"),
        F.when(ok, F.log("dollar")).alias("log_dollar"), F.when(ok, F.col("control_rv")).alias("control_rv"))


def har_features(spark: SparkSession, d: str) -> DataFrame:
    """HAR components in logs, session clock and the quarticity interaction."""
    def lg(c: str):
        return F.log(F.greatest(F.col(c), F.lit(1e-12)))

    b = b0_panel(spark, d).where(
        F.col("rv_back_6").isNotNull() & F.col("rv_prev_day").isNotNull() & F.col("rv_week").isNotNull())
    frac = F.col("bar") / 48.0
    rv = F.greatest(F.col("rv_back_6"), F.lit(1e-12))
    return b.withColumns({
        "log_rv": lg("rv_back_6"), "log_rv_session": lg("rv_session_to_date"), "log_rv_day": lg("rv_prev_day"),
        "log_rv_week": lg("rv_week"), "minute_fraction": frac, "minute_fraction_sq": frac * frac,
        "harq": F.sqrt(F.greatest("rq_back_6", F.lit(1e-12))) / rv * F.log(rv),
    })


def delayed_snapshots(spark: SparkSession, d: str, delays: list[int], tail: int) -> DataFrame:
    """Last bar available at each origin under each delay, with the trailing variance there."""
    from ..operators.ordered import asof_join

    w = Window.partitionBy("asset", "session_date").orderBy("bar")
    b = X.bars(spark, d).withColumn("r", F.log(F.col("close") / F.lag("close").over(w))).select(
        "asset", "session_date", F.col("bar").alias("source_bar"), F.col("close").alias("spot"),
        F.sum(F.col("r") * F.col("r")).over(w.rowsBetween(-(tail - 1), 0)).alias("rv_lag"))
    o = X.origins(spark, d).select(
        "origin_id", "asset", "session_date", "minute",
        F.explode(F.array(*[F.lit(x).cast("bigint") for x in delays])).alias("delay"))
    o = o.withColumn("at", floor_div(F.col("minute"), X.BAR_MINUTES) - F.col("delay"))
    out = asof_join(o, b, ["asset", "session_date"], "at", "source_bar", ["spot", "rv_lag"], 1000)
    return out.select("origin_id", "delay", "source_bar", "spot", "rv_lag")


def chain_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The tape with two-sided option prices that nearly obey parity at the stand-in strikes."""
    put = F.lit(25.0) + F.lit(0.1) * (F.col("strike") - 100.0) + (F.col("id") % 5) * 0.01
    call = put + F.lit(0.99) * (F.lit(101.0) - F.col("strike"))
    mid = F.when(F.col("option_type") == "call", call).otherwise(put)
    return X.tape(spark, d).withColumns({"bid": mid * 0.99, "ask": mid * 1.01})


def origin_spot(spark: SparkSession, d: str) -> DataFrame:
    """Spot at each half-hour: the close of the slot before it, on the scale of the strikes."""
    g = grid(spark, d).where(F.col("close").isNotNull())
    at = F.col("open_us") + (F.col("bar") + 1) * F.lit(X.SLOT_US)
    return g.select("asset", "session_date", floor_div(at, X.SLOT_US).alias("k"), chain_spot(F.col("close")).alias("spot"))


def chain_snapshot(spark: SparkSession, d: str, panes: int = 24) -> DataFrame:
    """Latest quote per contract and origin with spot, tenor, moneyness and days to expiry."""
    from ..functions.columns import date_micros
    from ..operators.joins import contract_snapshot

    s = contract_snapshot(chain_quotes(spark, d), X.SLOT_US, panes, 120, ["iv", "bid", "ask", "strike", "expiry", "option_type"])
    j = s.join(origin_spot(spark, d), ["asset", "k"])
    close = date_micros("expiry") + F.lit(960 * 60_000_000)
    return j.withColumns({
        "tenor": (close - F.col("origin_us")) / 1e6 / (365.0 * 86_400), "moneyness": F.col("strike") / F.col("spot"),
        "dte": F.datediff("expiry", "session_date").cast("bigint")})


def flow_and_variance(spark: SparkSession, d: str) -> DataFrame:
    """Signed premium visible under the two clocks beside trailing realized variance, per origin."""
    from ..functions.columns import trade_direction
    from ..operators import panes as P

    signed = F.col("premium") * trade_direction(F.col("tags"))
    cells = P.cells(P.with_panes(X.tape(spark, d), X.SLOT_US, 120), ["asset"], [F.count(F.lit(1)).alias("trades"), F.sum(signed).alias("signed_premium")])
    flow = P.spread(cells, 1, False).groupBy("asset", "k").agg(F.sum("trades").alias("trades"), F.sum("signed_premium").alias("signed_premium"))
    rv = returns(spark, d).select("asset", "session_date", ((F.col("bar") + 1) * X.BAR_MINUTES).alias("minute"), RZ.backward_rv(2).alias("trailing_rv"))
    o = P.origin_index(X.origins(spark, d), X.SLOT_US)
    return o.join(flow, ["asset", "k"], "left").join(rv, ["asset", "session_date", "minute"], "left").select(
        "origin_id", "asset", "session_date", "minute", F.coalesce("trades", F.lit(0).cast("bigint")).alias("trades"),
        F.round(F.coalesce("signed_premium", F.lit(0.0)), 4).alias("signed_premium"), "trailing_rv")
