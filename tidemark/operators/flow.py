"""Windowed trade-flow measures under two clocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import greeks as GK
from ..functions.columns import MICROS, ceil_div, floor_div, latency_seconds, trade_direction
from ..functions.time import tenor_years
from ..sources.results import materialise
from .features import lagged_trades, previous_trade_deltas
from .gaps import window_gap_squares
from .ordered import split_lag
from .panes import cells, spread, with_panes
from .quantiles import group_quantiles, quantiles_of_counts, window_quantiles

MULTIPLIER = 100.0
SHORT_TENOR_YEARS = 7.0 / 365.25
LONG_TENOR_YEARS = 30.0 / 365.25
OTM_LOG_MONEYNESS = 0.02


def decay_intensity(
    tape: DataFrame, step_us: int, cutoff_s: int, decay_s: float, slots: DataFrame, back: int
) -> DataFrame:
    """Exponentially decayed activity at each cutoff and its change over ``back`` steps.

    Rows count once visible and age on the exchange clock, never below zero; none ever leaves.
    Trades reduce to one number per (asset, session, first visible cutoff); these, one per
    cutoff of a session, are folded in order.  ``slots`` lists the session's origin indexes.
    """
    d = F.lit(cutoff_s * MICROS)
    k = ceil_div(F.col("created_us") + d, step_us)
    age = F.greatest(
        (k * F.lit(step_us) - d - F.col("executed_us")) / float(MICROS), F.lit(0.0)
    )
    fresh = (
        tape.select("asset", "session_date", k.alias("k"), F.exp(-age / decay_s).alias("_e"))
        .groupBy("asset", "session_date", "k")
        .agg(F.sum("_e").alias("_e"))
    )
    first = slots.groupBy("asset", "session_date").agg((F.min("k") - back).alias("_k0"), F.max("k").alias("_k1"))
    all_k = first.select("asset", "session_date", F.explode(F.sequence("_k0", "_k1")).alias("k"), "_k0")
    placed = all_k.join(
        fresh.join(first, ["asset", "session_date"])
        .where(F.col("k") <= F.col("_k1"))
        .withColumn(
            "_e",
            F.when(
                F.col("k") < F.col("_k0"),
                F.col("_e") * F.exp(-(F.col("_k0") - F.col("k")) * (step_us / MICROS / decay_s)),
            ).otherwise(F.col("_e")),
        )
        .withColumn("k", F.greatest("k", "_k0"))
        .groupBy("asset", "session_date", "k").agg(F.sum("_e").alias("_e")),
        ["asset", "session_date", "k"], "left",
    ).withColumn("_e", F.coalesce("_e", F.lit(0.0)))
    rows = placed.groupBy("asset", "session_date").agg(
        F.sort_array(F.collect_list(F.struct("k", "_e"))).alias("_r")
    )
    shrink = F.exp(F.lit(-(step_us / MICROS) / decay_s))
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<k:bigint,s:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] * shrink + x["_e"]
        return F.struct(
            s.alias("s"),
            F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), s.alias("s")))).alias("out"),
        )

    states = rows.select(
        "asset", "session_date", F.explode(F.aggregate("_r", zero, step)["out"]).alias("o")
    ).select("asset", "session_date", F.col("o.k").alias("k"), F.col("o.s").alias("intensity"))
    past = states.select("asset", "session_date", (F.col("k") + back).alias("k"), F.col("intensity").alias("_then"))
    return (
        slots.join(states, ["asset", "session_date", "k"], "left")
        .join(past, ["asset", "session_date", "k"], "left")
        .withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))
        .withColumn("innovation", F.col("intensity") - F.coalesce("_then", F.lit(0.0)))
        .drop("_then")
    )


def counting_windows(tape: DataFrame, origins: DataFrame, step_us: int, cutoff_s: int) -> DataFrame:
    """Tumbling (cutoff - step, cutoff] counts that tile a session, the first reaching back.

    A record on an edge belongs to the earlier window only; summed over origins each visible
    trade of the session counts once.
    """
    t = tape.withColumn("_seen", ceil_div(F.col("created_us") + F.lit(cutoff_s * MICROS), step_us))
    o = origins.withColumn("k", floor_div(F.col("origin_us"), step_us))
    first = o.groupBy("asset", "session_date").agg(F.min("k").alias("_first"), F.max("k").alias("_last"))
    lat = latency_seconds(F.col("created_us"), F.col("executed_us"))
    placed = (
        t.join(first, ["asset", "session_date"])
        .where(F.col("_seen") <= F.col("_last"))
        .withColumn("k", F.greatest("_seen", "_first"))
        .withColumn("latency", lat)
    )
    counts = placed.groupBy("asset", "session_date", "k").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("latency").alias("mean_latency_s"),
        F.count_if(F.col("expiry") == F.col("session_date")).alias("zero_dte_trades"),
        F.count_if(F.col("created_us") > F.col("k") * F.lit(step_us) - F.lit(cutoff_s * MICROS)).alias("violations"),
    )
    tail = group_quantiles(placed, ["asset", "session_date", "k"], "latency", {"p95_latency_s": 0.95})
    keys = ["asset", "session_date", "k"]
    z = F.lit(0).cast("bigint")
    return (
        o.join(counts, keys, "left").join(tail, keys, "left")
        .select(
            "origin_id", F.coalesce("trades", z).alias("trades"),
            F.coalesce("zero_dte_trades", z).alias("zero_dte_trades"), F.coalesce("violations", z).alias("violations"),
            F.coalesce("mean_latency_s", F.lit(0.0)).alias("mean_latency_s"),
            F.coalesce("p95_latency_s", F.lit(0.0)).alias("p95_latency_s"),
        )
    )


ACTIVITY_SUMS = ("trades", "null_premium", "negative_premium", "total_premium", "call_premium",
                 "put_premium", "ask_premium", "bid_premium")


def _premium_aggs() -> list[Column]:
    p = F.greatest(F.coalesce("premium", F.lit(0.0)), F.lit(0.0))
    side = F.coalesce(F.col("tags"), F.lit(""))
    kind = F.lower("option_type")
    return [
        F.count(F.lit(1)).alias("trades"),
        F.count_if(F.col("premium").isNull()).alias("null_premium"),
        F.count_if(F.col("premium") < 0).alias("negative_premium"),
        F.sum(p).alias("total_premium"),
        F.sum(F.when(kind == "call", p).otherwise(0.0)).alias("call_premium"),
        F.sum(F.when(kind == "put", p).otherwise(0.0)).alias("put_premium"),
        F.sum(F.when(side.contains("ask_side"), p).otherwise(0.0)).alias("ask_premium"),
        F.sum(F.when(side.contains("bid_side"), p).otherwise(0.0)).alias("bid_premium"),
        F.max(p).alias("max_premium"),
        F.max("created_us").alias("max_created_us"),
    ]


def activity(
    tape: DataFrame, origins: DataFrame, step_us: int, panes: int, delays: list[int]
) -> DataFrame:
    """Per (origin, delay) activity of executions in [end - window, end), end = origin - delay.

    Records must exist by ``end``.  An origin without activity reads zero.  Contract, strike and
    expiry detail comes from pane cells at contract grain; the rest is summed from the same
    cells.
    """
    delay = F.explode(F.array(*[F.lit(x).cast("bigint") for x in delays]))
    dims = ["asset", "contract", "strike", "expiry"]
    fine = fine_cells(tape, dims, step_us, delays, _premium_aggs())
    again = [(F.max if c.startswith("max_") else F.sum)(c).alias(c) for c in fine.columns if c not in (*dims, "executed_us", "created_us")]
    base = cells(with_panes(fine.withColumn("delay_s", delay), step_us, F.col("delay_s")), ["delay_s", *dims], again)
    keys = ["asset", "delay_s", "k"]
    dims = dimension_sums(spread(base, panes, True), keys, "trades", ACTIVITY_SUMS, ("max_premium", "max_created_us"))
    c = F.col("_dim") == "contract"
    again = c & (F.col("_w") > 1)
    out = dims.groupBy(*keys).agg(
        *[F.sum(x).alias(x) for x in ACTIVITY_SUMS],
        F.count_if(c).alias("contracts"), F.max("max_premium").alias("max_premium"), F.max("max_created_us").alias("max_created_us"),
        F.sum(F.when(again, F.col("total_premium")).otherwise(0.0)).alias("repeated_premium"),
        F.sum(F.when(again, F.col("_w")).otherwise(0)).alias("repeated_trades"),
        *[(F.max(F.when(F.col("_dim") == x, F.col("_w"))) / F.sum(F.when(F.col("_dim") == x, F.col("_w")))).alias(f"{x}_concentration")
          for x in ("strike", "expiry")],
    )
    o = origins.withColumn("k", floor_div(F.col("origin_us"), step_us)).select(
        "origin_id", "asset", "session_date", "minute", "origin_us", "k", delay.alias("delay_s"))
    j = o.join(out, keys, "left")
    zero_long = ("trades", "null_premium", "negative_premium", "contracts", "repeated_trades")
    zero_dbl = ("total_premium", "call_premium", "put_premium", "ask_premium", "bid_premium", "max_premium",
                "repeated_premium", "strike_concentration", "expiry_concentration")
    j = j.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in zero_long})
    j = j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero_dbl})
    has = F.col("total_premium") > 0
    return j.withColumn("ask_share", F.when(has, F.col("ask_premium") / F.col("total_premium")).otherwise(0.0)).withColumn(
        "bid_share", F.when(has, F.col("bid_premium") / F.col("total_premium")).otherwise(0.0)
    ).drop("k", "ask_premium", "bid_premium")


def fine_cells(tape: DataFrame, keys: list[str], step_us: int, delays: list[int], aggs: list[Column]) -> DataFrame:
    """The tape summed to the finest panes that every delay and the step are multiples of.

    The clocks are replaced by the panes' edges, on which each delay decides its panes exactly as
    on the trades, so delays multiply cells and never the tape.
    """
    unit = math.gcd(step_us, *[x * MICROS for x in delays])
    c = cells(with_panes(tape, unit), keys, aggs)
    return c.withColumns({"executed_us": F.col("exec_pane") * F.lit(unit), "created_us": F.col("seen_pane") * F.lit(unit)}).drop("exec_pane", "seen_pane")


def dimension_sums(
    per: DataFrame, keys: list[str], weight: str, sums: tuple[str, ...], maxima: tuple[str, ...] = ()
) -> DataFrame:
    """Weights per (keys, dimension, value) for contract, strike and expiry in one shuffle.

    The other measures travel on the contract rows only, so totals and all concentrations of a
    window come from one pass and need no self joins.
    """
    day = F.datediff("expiry", F.lit("1970-01-01").cast("date")).cast("bigint")
    values = {"contract": F.col("contract"), "strike": F.round(F.col("strike") * 1000.0).cast("bigint"), "expiry": day}
    dims = F.explode(F.array(*[F.struct(F.lit(n).alias("d"), v.alias("v")) for n, v in values.items()]))
    rows = per.withColumn("_d", dims).where(F.col("_d.v").isNotNull())
    main = F.col("_d.d") == "contract"
    return rows.groupBy(*keys, F.col("_d.d").alias("_dim"), F.col("_d.v").alias("_val")).agg(
        F.sum(weight).alias("_w"), *[F.sum(F.when(main, F.col(c))).alias(c) for c in sums],
        *[F.max(F.when(main, F.col(c))).alias(c) for c in maxima])


def wide_activity(
    tape: DataFrame, origins: DataFrame, step_us: int, panes: int, delays: list[int]
) -> DataFrame:
    """Activity plus sizes, midpoint premium, flags, and medians of IV, moneyness and tenor.

    ``origins`` carries ``spot``.  The medians are exact: values are counted per pane cell, the
    counts spread over windows and the ranks found on the counts.
    """
    delay = F.explode(F.array(*[F.lit(x).cast("bigint") for x in delays]))
    keys = ["asset", "delay_s", "k"]

    def delayed(fine: DataFrame) -> DataFrame:
        return with_panes(fine.withColumn("delay_s", delay), step_us, F.col("delay_s"))

    p = F.coalesce("premium", F.lit(0.0))
    good = (F.col("bid") > 0) & (F.col("ask") > F.col("bid")) & F.col("price").isNotNull()
    sums = {
        "n": F.lit(1), "total_size": F.col("size"), "_mid": F.when(good, p).otherwise(0.0),
        "_multi": F.col("tags").contains("multileg").cast("int"), "_sweep": F.col("flags").contains("sweep").cast("int"),
        "_iv_n": F.col("iv").isNotNull().cast("int"), "_valid": (F.col("price").isNotNull() & F.col("premium").isNotNull()).cast("int"),
        "_prem": p,
    }
    fine = fine_cells(tape, ["asset"], step_us, delays, [
        *[F.sum(c).alias(n) for n, c in sums.items()], F.max("size").alias("max_size"), F.max("iv").alias("_iv_hi"), F.min("iv").alias("_iv_lo")])
    base = cells(delayed(fine), keys[:2], [
        *[F.sum(n).alias(n) for n in sums], F.max("max_size").alias("max_size"), F.max("_iv_hi").alias("_iv_hi"), F.min("_iv_lo").alias("_iv_lo")])
    agg = spread(base, panes, True).groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in sums], F.max("max_size").alias("max_size"),
        F.max("_iv_hi").alias("_iv_hi"), F.min("_iv_lo").alias("_iv_lo"))
    o = origins.withColumn("k", floor_div(F.col("origin_us"), step_us)).select(
        "origin_id", "asset", "session_date", "spot", "k", delay.alias("delay_s"))

    def counts(value: str) -> DataFrame:
        seen = fine_cells(tape.where(F.col(value).isNotNull()), ["asset", value], step_us, delays, [F.count(F.lit(1)).alias("_c")])
        c = cells(delayed(seen), [*keys[:2], value], [F.sum("_c").alias("_c")])
        return spread(c, panes, True).groupBy(*keys, value).agg(F.sum("_c").alias("_c"))

    def at_origin(value: str, expr: Column) -> DataFrame:
        return counts(value).join(o.select(*keys, "spot", "session_date"), keys).select(*keys, expr.cast("double").alias("_v"), "_c").where(
            F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))

    iv = quantiles_of_counts(counts("iv").withColumnRenamed("iv", "_v"), keys, {"iv_median": 0.5})
    mny = quantiles_of_counts(at_origin("strike", F.abs(F.col("strike") / F.col("spot") - 1.0)), keys, {"abs_moneyness_median": 0.5})
    dte = quantiles_of_counts(at_origin("expiry", F.datediff("expiry", "session_date")), keys, {"dte_median": 0.5})
    j = o.join(agg, keys, "left").join(iv, keys, "left").join(mny, keys, "left").join(dte, keys, "left")
    n = F.col("n")
    z = F.lit(0.0)
    return j.select(
        "origin_id", "delay_s", F.coalesce(n, F.lit(0).cast("bigint")).alias("trades"),
        F.coalesce("total_size", F.lit(0).cast("bigint")).alias("total_size"), F.coalesce("max_size", F.lit(0).cast("bigint")).alias("max_size"),
        F.coalesce(F.when(F.col("_prem") > 0, F.col("_mid") / F.col("_prem")), z).alias("midpoint_share"),
        F.coalesce(F.col("_multi") / n, z).alias("multileg_share"), F.coalesce(F.col("_sweep") / n, z).alias("sweep_share"),
        F.when(F.col("_iv_n") >= 2, F.col("_iv_hi") - F.col("_iv_lo")).alias("iv_range"),
        F.coalesce(F.col("_valid") / n, z).alias("valid_share"), F.coalesce(1.0 - F.col("_iv_n") / n, F.lit(1.0)).alias("missing_iv_share"),
        "iv_median", F.coalesce("abs_moneyness_median", z).alias("abs_moneyness_median"), F.coalesce("dte_median", z).alias("dte_median"),
    )


def compact_features(a: DataFrame) -> DataFrame:
    """Nine zero-safe features of an activity frame."""
    n, prem = F.col("trades").cast("double"), F.col("total_premium")
    cp = F.col("call_premium") + F.col("put_premium")
    return a.select(
        "origin_id", "asset", "session_date", "minute",
        F.log1p(n).alias("log_trades"),
        F.when(n > 0, F.col("contracts") / n).otherwise(0.0).alias("unique_share"),
        F.when(n > 0, F.log1p(prem / n)).otherwise(0.0).alias("log_mean_premium"),
        F.log1p("max_premium").alias("log_max_premium"),
        F.when(cp > 0, (F.col("call_premium") - F.col("put_premium")) / cp).otherwise(0.0).alias("call_put_imbalance"),
        (F.col("ask_share") - F.col("bid_share")).alias("side_imbalance"),
        F.when(prem > 0, F.col("repeated_premium") / prem).otherwise(0.0).alias("repeated_share"),
        "strike_concentration", "expiry_concentration",
    )


def herfindahl(w: Column, normalised: bool = True) -> Column:
    """Aggregate: concentration of the positive weights of a group."""
    pos = F.when(w > 0, w)
    h = F.sum(pos * pos) / F.pow(F.sum(pos), 2.0)
    n = F.count(pos)
    return F.when(n >= 2, (h - 1.0 / n) / (1.0 - 1.0 / n)) if normalised else h


def entropy(w: Column, normalised: bool = True) -> Column:
    """Aggregate: Shannon entropy of the positive weights of a group."""
    pos = F.when(w > 0, w)
    s = F.sum(pos)
    e = F.log(s) - F.sum(pos * F.log(pos)) / s
    n = F.count(pos)
    return F.when(n >= 2, e / F.log(n.cast("double"))) if normalised else e


def gap_moments(events: DataFrame, keys: list[str], time_us: str, bucket_us: int) -> DataFrame:
    """Gaps between consecutive times of a key: rows (keys, _t, _n copies, _g gap before)."""
    distinct = events.groupBy(*keys, F.col(time_us).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    lagged = split_lag(distinct, keys, ["_t"], floor_div(F.col("_t"), bucket_us), ["_t"])
    return lagged.withColumn("_g", (F.col("_t") - F.col("prev__t")) / float(MICROS))


def burstiness(events: DataFrame, keys: list[str], time_us: str, bucket_us: int) -> DataFrame:
    """Rate, interarrival coefficient of variation and median gap per key; null under 3 rows.

    Equal times collapse first: n copies are n-1 zero gaps, kept as a count.  Gaps between
    distinct times come from a bucketed lag, so one busy key is not one task.
    """
    gaps = gap_moments(events, keys, time_us, bucket_us)
    stats = gaps.groupBy(*keys).agg(
        F.sum("_n").alias("events"), F.sum(F.col("_n") - 1).alias("_ties"),
        ((F.max("_t") - F.min("_t")) / float(MICROS)).alias("_span"), F.sum(F.col("_g") * F.col("_g")).alias("_sq"))
    counted = gaps.where(F.col("_g").isNotNull()).groupBy(*keys, F.col("_g").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    ties = stats.where(F.col("_ties") > 0).select(*keys, F.lit(0.0).alias("_v"), F.col("_ties").alias("_c"))
    med = quantiles_of_counts(counted.unionByName(ties), keys, {"interarrival_median": 0.5})
    m = F.col("events") - 1
    mean = F.col("_span") / m
    var = F.greatest(F.col("_sq") / m - mean * mean, F.lit(0.0))
    enough = F.col("events") >= 3
    return stats.join(med, keys, "left").select(
        *keys, "events",
        F.when(enough & (F.col("_span") > 0), F.col("events") / F.col("_span")).alias("rate_per_second"),
        F.when(enough & (F.col("_span") > 0), F.sqrt(var) / mean).alias("interarrival_cv"),
        F.when(enough, F.col("interarrival_median")).alias("interarrival_median"),
    )


def quote_impact(tape: DataFrame, by: list[str]) -> DataFrame:
    """Mean change of IV, relative mid and spread between consecutive trades of a contract."""
    t = previous_trade_deltas(tape).where(F.col("has_previous"))
    return t.groupBy(*by).agg(
        F.avg("d_iv").alias("d_iv"), F.avg("d_mid_rel").alias("d_mid_rel"), F.avg("d_spread").alias("d_spread"),
        F.count(F.lit(1)).alias("pairs"),
    )


def trade_channels(tape: DataFrame) -> DataFrame:
    """Per-trade channels of the flow record.

    Reads bid, ask, size, premium, iv, strike, expiry_close_us, option_type, tags, flags,
    multi_vol, mark and the two clocks.
    """
    t = lagged_trades(tape)
    multi = F.col("multileg_size") > 0
    is_call = F.col("option_type") == "call"
    t = t.withColumn("direction", trade_direction(F.col("tags"), multi)).withColumn(
        "tenor", tenor_years(F.col("expiry_close_us"), F.col("executed_us"))
    )
    g = GK.greeks(F.col("mark"), F.col("strike"), F.col("tenor"), F.col("iv"), is_call)
    # The select barrier keeps each generated method small.
    t = t.withColumns({"_delta": g.delta, "_gamma": g.gamma, "_vega": g.vega})
    w = F.col("size") * MULTIPLIER * F.col("direction")
    lm = F.log(F.greatest("strike", F.lit(1e-9)) / F.greatest("mark", F.lit(1e-9)))
    zero = F.col("expiry") == F.col("session_date")
    prem, d = F.col("premium"), F.col("direction")
    lat = latency_seconds(F.col("created_us"), F.col("executed_us"))

    def only(cond: Column, x: Column) -> Column:
        return F.when(cond, x).otherwise(0.0)

    return t.withColumns({
        "vega_flow": F.col("_vega") * w,
        "gamma_flow": F.col("_gamma") * w * F.col("mark") * F.col("mark"),
        "delta_flow": F.col("_delta") * w * F.col("mark"),
        "vega_flow_abs": F.abs(F.col("_vega") * F.col("size") * MULTIPLIER),
        "vega_flow_call": only(is_call, F.col("_vega") * w),
        "vega_flow_put": only(~is_call, F.col("_vega") * w),
        "vega_flow_short_dte": only(F.col("tenor") <= SHORT_TENOR_YEARS, F.col("_vega") * w),
        "vega_flow_long_dte": only(F.col("tenor") > LONG_TENOR_YEARS, F.col("_vega") * w),
        "zero_dte_premium": only(zero, prem),
        "zero_dte_signed_premium": only(zero, prem * d),
        "zero_dte_trades": only(zero, F.lit(1.0)),
        "otm_premium": only(F.when(is_call, lm > OTM_LOG_MONEYNESS).otherwise(lm < -OTM_LOG_MONEYNESS), prem),
        "buy_premium": only(d > 0, prem), "sell_premium": only(d < 0, prem), "passive_premium": only(d == 0, prem),
        "sweep_premium": only(F.coalesce(F.col("flags"), F.lit("")).contains("sweep"), prem),
        "multileg_premium": only(multi, prem),
        "previous": F.col("has_previous").cast("double"),
        "latency": lat, "late": only(lat > 60.0, F.lit(1.0)),
    })


CHANNEL_SUMS = (
    "size", "premium", "vega_flow", "gamma_flow", "delta_flow", "vega_flow_abs", "vega_flow_call", "vega_flow_put",
    "vega_flow_short_dte", "vega_flow_long_dte", "zero_dte_premium", "zero_dte_signed_premium", "zero_dte_trades",
    "otm_premium", "buy_premium", "sell_premium", "passive_premium", "sweep_premium", "multileg_size",
    "multileg_premium", "d_iv", "d_mid_rel", "d_spread", "previous", "latency", "late",
)


def flow_record(
    tape: DataFrame, origins: DataFrame, step_us: int, panes: int, cutoff_s: int, concentration: bool
) -> DataFrame:
    """The window flow record per origin: totals, shares, means, concentration and latency tail.

    The window is closed at the cutoff on the availability clock and bounded below on the
    exchange clock.  All sums come from pane cells at contract grain.
    """
    t = with_panes(trade_channels(tape), step_us, cutoff_s)
    step_s = step_us / MICROS
    # Ages stay small numbers: the offset to the pane boundary now, whole steps after the spread.
    offset = (F.col("seen_pane") * F.lit(step_us) - F.col("created_us") - F.lit(cutoff_s * MICROS)) / float(MICROS)
    base = cells(
        t, ["asset", "contract", "strike", "expiry"],
        [F.count(F.lit(1)).alias("trades"), *[F.sum(c).alias(c) for c in CHANNEL_SUMS], F.sum(offset).alias("_off"),
         F.min("executed_us").alias("_t0"), F.max("executed_us").alias("_t1")],
    )
    keys = ["asset", "k"]
    per = spread(base, panes, False).withColumn(
        "age", F.col("_off") + F.col("trades") * (F.col("k") - F.col("seen_pane")) * step_s).withColumn("_t0", -F.col("_t0"))
    dims = dimension_sums(per, keys, "premium", ("trades", "age", *CHANNEL_SUMS), ("_t0", "_t1"))

    def weight(name: str) -> Column:
        return F.when(F.col("_dim") == name, F.col("_w"))

    extra = [herfindahl(weight("strike")).alias("strike_hhi"), herfindahl(weight("expiry")).alias("expiry_hhi"),
             entropy(weight("contract")).alias("contract_entropy")] if concentration else []
    out = dims.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("trades", "age", *CHANNEL_SUMS)],
        F.count_if(F.col("_dim") == "contract").alias("contracts"),
        ((F.max("_t1") + F.max("_t0")) / float(MICROS)).alias("observed_span_s"), *extra)
    # The latency tail and the gaps need an order; they read the clocks only, written once for all their branches.
    clocks = materialise(with_panes(tape.select("asset", "executed_us", "created_us"), step_us, cutoff_s))
    tail = window_quantiles(
        clocks, ["asset", "exec_pane", "seen_pane"], keys, lambda c: spread(c, panes, False),
        latency_seconds(F.col("created_us"), F.col("executed_us")), {"p95_latency_s": 0.95})
    out = out.join(tail, keys, "left")
    if concentration:
        out = out.join(window_gap_squares(clocks, ["asset"], "executed_us", panes), keys, "left")
        m, span = F.col("trades") - 1, F.col("observed_span_s")
        var = F.greatest(F.col("gap_squares") / m - F.pow(span / m, 2.0), F.lit(0.0))
        out = out.withColumn("interarrival_cv", F.when((m > 0) & (span > 0), F.sqrt(var) / (span / m)))
    o = origins.withColumn("k", floor_div(F.col("origin_us"), step_us)).select("origin_id", "asset", "session_date", "minute", "origin_us", "k")
    j = o.join(out, keys, "left")
    window_s = panes * step_us / MICROS
    z = F.lit(0.0)
    j = j.withColumns({c: F.coalesce(c, z) for c in CHANNEL_SUMS}).withColumns({
        "trades": F.coalesce("trades", F.lit(0).cast("bigint")), "contracts": F.coalesce("contracts", F.lit(0).cast("bigint"))})
    prem = F.greatest("premium", F.lit(1e-9))
    n = F.col("trades")
    before = F.greatest("previous", F.lit(1.0))
    cols = {
        "trades": n, "contracts": F.col("contracts"), "size": F.col("size"), "premium": F.col("premium"),
        **{c: F.col(c) for c in CHANNEL_SUMS if c.endswith("_flow") or c.startswith("vega_flow_")},
        **{f"{c}_premium_share": F.col(f"{c}_premium") / prem for c in
           ("otm", "buy", "sell", "passive", "sweep", "multileg", "zero_dte")},
        "multileg_size_share": F.col("multileg_size") / F.greatest("size", F.lit(1e-9)),
        "d_iv": F.col("d_iv") / before, "d_mid_rel": F.col("d_mid_rel") / before, "d_spread": F.col("d_spread") / before,
        "rate_per_second": n / window_s, "observed_span_s": F.coalesce("observed_span_s", z),
        "is_empty_window": F.when(n == 0, 1.0).otherwise(0.0),
        "mean_age_s": F.when(n > 0, F.col("age") / n).otherwise(0.0),
        "mean_provider_latency_s": F.when(n > 0, F.col("latency") / n).otherwise(0.0),
        "late_arrival_share": F.when(n > 0, F.col("late") / n).otherwise(0.0),
        "p95_provider_latency_s": F.coalesce("p95_latency_s", z),
        "zero_dte_signed_premium": F.col("zero_dte_signed_premium"),
        "zero_dte_trade_share": F.col("zero_dte_trades") / F.greatest(n.cast("double"), F.lit(1.0)),
    }
    if concentration:
        cols |= {c: F.when(n == 0, 0.0).otherwise(F.col(c)) for c in ("strike_hhi", "expiry_hhi", "contract_entropy", "interarrival_cv")}
    return j.select("origin_id", "asset", "session_date", "minute", *[c.alias(name) for name, c in cols.items()])
