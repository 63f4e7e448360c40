"""Queries over point-in-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import floor_div, qlike
from ..operators import joins as J
from ..operators import panes as N
from ..operators import quality as Q
from ..operators.quantiles import group_quantiles
from . import panels as PN
from . import standin as X
from .q_flt import FEATURES_SQL, features
from .registry import query
from .standin import sql


@query("jn1_attach_features", sql("SELECT origin_id, b0_close, b1_close, b2_trades FROM feat", FEATURES_SQL))
def _(spark, d):
    f = features(spark, d)
    return J.attach(X.origins(spark, d).select("origin_id"), [
        f.select("origin_id", "b0_close"), f.select("origin_id", "b0_close", "b1_close"),
        f.select("origin_id", "b2_trades")], "origin_id")


@query("jn2_deduplicate_sources", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, close,
  CASE WHEN day(session_date)%2=0 THEN 'a' ELSE 'b' END AS source FROM bars"""))
def _(spark, d):
    b = X.bars(spark, d).select("asset", "session_date", "bar", "close")
    a = b.where(F.dayofmonth("session_date") % 2 == 0).withColumn("source", F.lit("a"))
    return J.deduplicate_sources(a.unionByName(b.withColumn("source", F.lit("b"))))


@query("jn3_key_difference", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, 'missing' AS side FROM grid0 ANTI JOIN bars USING (asset, session_date, bar)
UNION ALL SELECT asset, session_date::VARCHAR, bar, 'unexpected' FROM bars ANTI JOIN grid0 USING (asset, session_date, bar)"""))
def _(spark, d):
    return J.key_difference(PN.slots(spark, d), X.bars(spark, d), ["asset", "session_date", "bar"])


@query("jn4_market_controls", sql("""
SELECT coalesce(a.session_date,b.session_date)::VARCHAR AS session_date, coalesce(a.bar,b.bar) AS bar,
 a.close AS click_close, a.volume AS click_volume, b.close AS view_close, b.volume AS view_volume
FROM (FROM bars WHERE asset='click') a FULL JOIN (FROM bars WHERE asset='view') b
 ON a.session_date=b.session_date AND a.bar=b.bar"""))
def _(spark, d):
    b = X.bars(spark, d)
    pick = {n: b.where(F.col("asset") == n).select("session_date", "bar", "close", "volume") for n in ("click", "view")}
    return J.full_outer_controls(pick, ["session_date", "bar"])


@query("jn5_inclusion_grid", sql("""
SELECT origin_id, b.bar IS NOT NULL AS included FROM origins o LEFT JOIN bars b
 ON b.asset=o.asset AND b.session_date=o.session_date AND b.bar=o.minute//30"""))
def _(spark, d):
    seen = X.bars(spark, d).select("asset", "session_date", (F.col("bar") * 30).alias("minute"))
    return J.inclusion_grid(X.origins(spark, d), seen, ["asset", "session_date", "minute"]).select("origin_id", "included")


@query("jn6_last_quote_asof", sql("""
SELECT o.origin_id, q.created_us AS quote_us, q.bid, q.ask FROM origins o ASOF LEFT JOIN
 (SELECT asset, created_us, arg_max(bid, id) AS bid, arg_max(ask, id) AS ask FROM tape GROUP BY 1,2) q
 ON o.asset=q.asset AND o.origin_us-120000000 >= q.created_us"""))
def _(spark, d):
    q = X.tape(spark, d).select("asset", F.col("created_us").alias("quote_us"), "id", "bid", "ask")
    return J.last_quote(X.origins(spark, d), q, ["asset"], 120, ["bid", "ask"]).select(
        "origin_id", "quote_us", "bid", "ask")


SNAP_SQL = """snap AS (
  SELECT o.asset, o.origin_us, t.contract, count(*) AS records, max(t.created_us) AS created_us,
    arg_max(t.iv, (t.created_us, t.id)) AS iv, arg_max(t.bid, (t.created_us, t.id)) AS bid, arg_max(t.ask, (t.created_us, t.id)) AS ask,
    arg_max(t.strike, (t.created_us, t.id)) AS strike, arg_max(t.expiry, (t.created_us, t.id)) AS expiry,
    arg_max(t.option_type, (t.created_us, t.id)) AS option_type
  FROM (SELECT DISTINCT asset, unnest(generate_series(
     ((created_us+120000000+1799999999)//1800000000)*1800000000, ((created_us+120000000)//1800000000)*1800000000 + 7200000000, 1800000000)) AS origin_us
     FROM tape) o
  JOIN tape t ON t.asset=o.asset AND t.created_us BETWEEN o.origin_us-120000000-7200000000 AND o.origin_us-120000000
  GROUP BY 1,2,3)"""


@query("jn7_contract_snapshot", sql("""
SELECT asset, origin_us, contract, records, created_us, iv, (origin_us-created_us)/1e6::DOUBLE AS quote_age_s FROM snap""", SNAP_SQL))
def _(spark, d):
    return J.contract_snapshot(X.tape(spark, d), X.SLOT_US, 4, 120, ["iv"]).select(
        "asset", "origin_us", "contract", "records", "created_us", "iv", "quote_age_s")


@query("jn8_trailing_bars", sql("""
SELECT o.origin_id, round(sum(r.r*r.r),6) AS rv_lag, count(r.r) AS window_bars FROM origins o JOIN rets r
 ON r.asset=o.asset AND r.session_date=o.session_date AND r.bar*30 >= o.minute-120 AND r.bar*30 < o.minute GROUP BY 1"""))
def _(spark, d):
    r = PN.returns(spark, d).withColumn("at", F.col("open_us") + F.col("bar") * X.SLOT_US)
    sums = J.trailing_sum(r, F.col("at"), X.SLOT_US, 4, {
        "rv_lag": F.col("r") * F.col("r"), "window_bars": F.when(F.col("r").isNotNull(), 1).otherwise(0)})
    o = N.origin_index(X.origins(spark, d), X.SLOT_US)
    return o.join(sums, ["asset", "session_date", "k"]).select("origin_id", "rv_lag", "window_bars")


@query("jn9_window_assign", sql("""
SELECT t.id, o.origin_id FROM tape t JOIN origins o ON o.asset=t.asset
 AND t.executed_us >= o.origin_us-60000000-3600000000 AND t.executed_us < o.origin_us-60000000 AND t.created_us <= o.origin_us-60000000"""))
def _(spark, d):
    return N.window_rows(X.tape(spark, d), X.origins(spark, d), X.SLOT_US, 2, 60, True).select("id", "origin_id")


@query("jn10_exact_lag", sql("""
SELECT a.origin_id, b.b0_close AS b0_close_30m, c.b0_close AS b0_close_60m FROM feat a
LEFT JOIN feat b ON b.asset=a.asset AND b.session_date=a.session_date AND b.minute=a.minute-30
LEFT JOIN feat c ON c.asset=a.asset AND c.session_date=a.session_date AND c.minute=a.minute-60""", FEATURES_SQL))
def _(spark, d):
    f = features(spark, d).select("origin_id", "asset", "session_date", "minute", "b0_close")
    keys = ["asset", "session_date"]
    one = J.exact_lag(f, keys, "minute", 30, ["b0_close"], "30m")
    two = f.select(*keys, (F.col("minute") + 60).alias("minute"), F.col("b0_close").alias("b0_close_60m"))
    return one.join(two, [*keys, "minute"], "left").select("origin_id", "b0_close_30m", "b0_close_60m")


@query("jn11_mark_price", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, CASE WHEN bar=0 THEN open ELSE lag(close) OVER
 (PARTITION BY asset, session_date ORDER BY bar) END AS mark FROM grid"""))
def _(spark, d):
    return PN.marks(spark, d)


PAIRS_SQL = """lastq AS (SELECT asset, session_date, expiry, strike, option_type, arg_max(iv, (created_us,id)) AS iv,
   arg_max((bid+ask)/2.0::DOUBLE, (created_us,id)) AS mid FROM tape GROUP BY ALL),
 pairs AS (SELECT c.asset, c.session_date, c.expiry, c.strike, c.iv AS call_iv, p.iv AS put_iv, c.mid AS call_mid, p.mid AS put_mid
   FROM lastq c JOIN lastq p USING (asset, session_date, expiry, strike) WHERE c.option_type='call' AND p.option_type='put')"""


def pairs(spark, d):
    return J.co_strike_pairs(PN.last_session_quotes(spark, d), ["asset", "session_date", "expiry", "strike"], ["iv", "mid"])


@query("jn12_co_strike_pairs", sql("""
SELECT asset, session_date::VARCHAR AS session_date, expiry::VARCHAR AS expiry, strike, round((call_iv+put_iv)/2,6) AS consensus_iv,
 round(call_mid,6) AS call_mid, round(put_mid,6) AS put_mid FROM pairs""", PAIRS_SQL))
def _(spark, d):
    return pairs(spark, d).select("asset", "session_date", "expiry", "strike",
                                  ((F.col("call_iv") + F.col("put_iv")) / 2).alias("consensus_iv"), "call_mid", "put_mid")


def vendor_b(spark, d):
    """The same bars with one in 53 a slot late."""
    b = X.bars(spark, d)
    n = F.dayofmonth("session_date") * 48 + F.col("bar")
    return b.withColumn("bar", F.col("bar") + F.when(n % 53 == 0, 1).otherwise(0))


@query("jn13_bar_reconciliation", sql("""
SELECT label, count(*) AS matched, round(quantile_cont(rel,0.5),6) AS median_rel_diff, round(max(rel),6) AS max_rel_diff,
 round(avg(CASE WHEN rel=0 THEN 1.0::DOUBLE ELSE 0 END),6) AS exact_share FROM (
 SELECT s.label, abs(a.close-b.close)/b.close AS rel FROM bars a, (VALUES ('same_label',0),('plus_one',1)) s(label, off),
  (SELECT asset, session_date, bar + CASE WHEN (day(session_date)*48+bar)%53=0 THEN 1 ELSE 0 END AS bar, close FROM bars) b
 WHERE b.asset=a.asset AND b.session_date=a.session_date AND b.bar=a.bar+s.off) GROUP BY 1"""))
def _(spark, d):
    j = J.reconcile_bars(X.bars(spark, d), vendor_b(spark, d), ["asset", "session_date"], "bar",
                         {"same_label": 0, "plus_one": 1})
    q = group_quantiles(j, ["label"], "rel_diff", {"median_rel_diff": 0.5})
    return j.groupBy("label").agg(
        F.count(F.lit(1)).alias("matched"), F.max("rel_diff").alias("max_rel_diff"),
        F.avg(F.when(F.col("rel_diff") == 0, 1.0).otherwise(0.0)).alias("exact_share")).join(q, "label")


@query("jn14_live_reconciliation", sql("""
SELECT asset, session_date::VARCHAR AS session_date, count(*) AS tape_rows, count(rec) AS matched,
 count(*) FILTER (rec IS NOT NULL AND id%17=0) AS revised, round(1-count(rec)/count(*)::DOUBLE,6) AS backfill_upper_bound,
 round(avg((rec-created_us)/1e6::DOUBLE),6) AS mean_latency_s
FROM (SELECT *, CASE WHEN id%11<>0 THEN created_us+31000000 END AS rec FROM tape) GROUP BY ALL"""))
def _(spark, d):
    fields = ["asset", "executed_us", "strike", "expiry", "id"]
    t = X.tape(spark, d).withColumn("fp", J.fingerprint(fields))
    live = t.withColumn("received_us", F.when(F.col("id") % 11 != 0, F.col("created_us") + 31_000_000)).where(
        F.col("received_us").isNotNull()).withColumn("size", F.col("size") + F.when(F.col("id") % 17 == 0, 1).otherwise(0))
    return J.reconcile_live(t, live.select("fp", "received_us", "size"), ["asset", "session_date"], ["size"])


RATES_SQL = """rates AS (SELECT date_trunc('month', o_orderdate)::DATE AS rate_date, round(avg(o_totalprice),6) AS rate FROM orders GROUP BY 1)"""


def rates(spark, d):
    return X.table(spark, d, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("rate_date")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("rate"))


@query("jn15_strictly_prior_rate", sql("""
SELECT p.origin_id, r.rate_date::VARCHAR AS rate_date, r.rate FROM panel p ASOF LEFT JOIN rates r ON p.session_date > r.rate_date""", RATES_SQL))
def _(spark, d):
    p = X.orders_series(spark, d).select("origin_id", "session_date")
    return J.prior_reference(p, rates(spark, d), "session_date", "rate_date", ["rate"]).select("origin_id", "rate_date", "rate")


@query("jn16_trailing_year_sum", sql("""
SELECT asset, session_date::VARCHAR AS session_date, round(sum(v) OVER (PARTITION BY asset ORDER BY session_date
  RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)/last,6) AS trailing_yield
FROM (SELECT asset, session_date, sum(actual) AS v, max(actual) AS last FROM panel GROUP BY 1,2)"""))
def _(spark, d):
    daily = X.orders_series(spark, d).groupBy("asset", "session_date").agg(
        F.sum("actual").alias("v"), F.max("actual").alias("last"))
    out = J.trailing_days(daily, ["asset"], "session_date", 365, "v", "total")
    return out.select("asset", "session_date", (F.col("total") / F.col("last")).alias("trailing_yield"))


@query("jn17_availability_mask", sql("""
SELECT origin_id, CASE WHEN minute%90<>0 THEN b2_trades END AS b2_trades FROM feat""", FEATURES_SQL))
def _(spark, d):
    f = features(spark, d).select("origin_id", "minute", "b2_trades")
    side = f.select("origin_id", (F.col("minute") % 90 != 0).alias("eligible"))
    return J.availability_mask(f, side, "origin_id", ["b2_trades"]).select("origin_id", "b2_trades")


@query("jn18_replace_columns", sql("SELECT origin_id, b1_close AS b0_close, b2_trades FROM feat", FEATURES_SQL))
def _(spark, d):
    f = features(spark, d).select("origin_id", "b0_close", "b1_close", "b2_trades")
    variant = f.select("origin_id", F.col("b1_close").alias("b0_close"))
    return J.replace_columns(f, variant, "origin_id", ["b0_close"]).drop("b1_close")


@query("jn19_eligible_events", sql("""
SELECT o.origin_id, count(t.id) AS events, max(t.executed_us) AS last_event_us FROM origins o LEFT JOIN
 (SELECT *, greatest(executed_us, created_us+120000000) AS u FROM tape WHERE flags='sweep') t ON t.asset=o.asset AND t.u<=o.origin_us GROUP BY 1"""))
def _(spark, d):
    e = X.tape(spark, d).select("asset", F.col("executed_us").alias("event_us"), F.col("created_us").alias("available_us"),
                                F.when(F.col("flags") == "sweep", "point_in_time").otherwise("date_only").alias("quality"))
    return J.eligible_events(X.origins(spark, d), e, 120).select("origin_id", "events", "last_event_us")


@query("jn20_lineage_counts", sql("""
SELECT o.origin_id, count(t.id) AS trades, count(t.id) FILTER (ask>bid) AS quotes, count(t.id) FILTER (flags='sweep') AS events
FROM origins o LEFT JOIN tape t ON t.asset=o.asset AND t.session_date=o.session_date AND t.created_us<=o.origin_us-120000000 GROUP BY 1"""))
def _(spark, d):
    t = X.tape(spark, d)
    return J.lineage_counts(X.origins(spark, d), {
        "trades": t, "quotes": t.where(F.col("ask") > F.col("bid")), "events": t.where(F.col("flags") == "sweep")},
        X.SLOT_US, 120)


@query("jn21_delayed_spot", sql("""
SELECT o.origin_id, a.close AS spot_1, b.close AS spot_2 FROM origins o
LEFT JOIN bars a ON a.asset=o.asset AND a.session_date=o.session_date AND a.bar=o.minute//30-1
LEFT JOIN bars b ON b.asset=o.asset AND b.session_date=o.session_date AND b.bar=o.minute//30-2"""))
def _(spark, d):
    b = X.bars(spark, d).select("asset", "session_date", "bar", "close")
    out = X.origins(spark, d).withColumn("bar", floor_div(F.col("minute"), 30))
    for n in (1, 2):
        out = out.join(b.select("asset", "session_date", (F.col("bar") + n).alias("bar"), F.col("close").alias(f"spot_{n}")),
                       ["asset", "session_date", "bar"], "left")
    return out.select("origin_id", "spot_1", "spot_2")


@query("jn22_event_neighbourhood", sql("""
SELECT o.origin_id, coalesce(bool_or(e.r IS NOT NULL), false) AS near_event FROM origins o
JOIN (SELECT session_date, row_number() OVER (ORDER BY session_date) AS r FROM (SELECT DISTINCT session_date FROM origins)) s USING (session_date)
LEFT JOIN (SELECT DISTINCT t.asset, s2.r FROM tape t JOIN (SELECT session_date, row_number() OVER (ORDER BY session_date) AS r
   FROM (SELECT DISTINCT session_date FROM origins)) s2 USING (session_date) WHERE t.size>=90 AND t.option_type='call' AND t.flags='sweep') e
 ON e.asset=o.asset AND abs(e.r-s.r)<=1 GROUP BY 1"""))
def _(spark, d):
    ev = X.tape(spark, d).where((F.col("size") >= 90) & (F.col("option_type") == "call") & (F.col("flags") == "sweep"))
    o = X.origins(spark, d)
    return J.event_neighbourhood(o, ev, o).select("origin_id", "near_event")


def losses(spark, d, which):
    p = X.orders_series(spark, d)
    return p.withColumn("loss", qlike(F.col("actual"), F.col(which)))


@query("jn23_paired_losses", sql("""
SELECT origin_id, round((actual/f_base-ln(actual/f_base)-1),6) AS loss_base, round((actual/f_wide-ln(actual/f_wide)-1),6) AS loss_wide,
 round((actual/f_base-ln(actual/f_base)-1)-(actual/f_wide-ln(actual/f_wide)-1),6) AS difference FROM panel"""))
def _(spark, d):
    return J.paired_losses(losses(spark, d, "f_base"), losses(spark, d, "f_wide"), ["origin_id"])


@query("jn24_key_set_difference", sql("""
SELECT asset, session_date::VARCHAR AS session_date, count(*) AS copies, 1::BIGINT AS frames FROM
 (SELECT DISTINCT asset, session_date FROM tape) WHERE (asset, session_date) NOT IN (SELECT (asset, session_date) FROM origins) GROUP BY ALL"""))
def _(spark, d):
    k = ["asset", "session_date"]
    return J.key_sets_differ([X.tape(spark, d).select(*k).distinct(), X.origins(spark, d).select(*k).distinct()], k)


@query("jn25_bind_targets", sql("SELECT origin_id, asset, round(actual,6) AS actual FROM panel"))
def _(spark, d):
    p = X.orders_series(spark, d)
    return J.bind_targets(p.select("origin_id", "asset"), p.select("origin_id", "actual"), "origin_id", "actual")


NESTED_SQL = """nested AS (
  SELECT a.origin_id, a.asset, a.session_date, a.b0_close, a.b1_close, a.b1_close-l.b1_close AS b1_change_30m,
    CASE WHEN a.minute%90<>0 THEN coalesce(a.b2_trades,0) END AS b2_trades FROM feat a
  LEFT JOIN feat l ON l.asset=a.asset AND l.session_date=a.session_date AND l.minute=a.minute-30)"""


def nested(spark, d):
    """Target-blind nested panel: price state, lagged option state, masked activity."""
    f = Q.strip_columns(features(spark, d))
    f = J.exact_lag(f, ["asset", "session_date"], "minute", 30, ["b1_close"], "lag")
    f = f.withColumn("b1_change_30m", F.col("b1_close") - F.col("b1_close_lag")).withColumn(
        "b2_trades", F.coalesce("b2_trades", F.lit(0).cast("bigint")))
    side = f.select("origin_id", (F.col("minute") % 90 != 0).alias("eligible"))
    out = J.availability_mask(f, side, "origin_id", ["b2_trades"])
    return out.select("origin_id", "asset", "session_date", "b0_close", "b1_close", "b1_change_30m", "b2_trades")


@query("jn26_target_blind_panel", sql("""
SELECT origin_id, asset, session_date::VARCHAR AS session_date, b0_close, b1_close, round(b1_change_30m,6) AS b1_change_30m, b2_trades FROM nested""",
                                    FEATURES_SQL, NESTED_SQL))
def _(spark, d):
    out = nested(spark, d)
    Q.forbid_columns(out)
    return out


@query("jn27_nested_matrices", sql("""
SELECT asset, CASE WHEN b0_close IS NULL THEN 'B0_INCOMPLETE' WHEN b1_close IS NULL OR b1_change_30m IS NULL THEN 'B1_INCOMPLETE'
  WHEN b2_trades IS NULL THEN 'B2_INCOMPLETE' ELSE 'NONE' END AS reason, count(*) AS origins,
 count(*) FILTER (b0_close IS NOT NULL) AS b0_rows, count(*) FILTER (b0_close IS NOT NULL AND b1_close IS NOT NULL AND b1_change_30m IS NOT NULL) AS b1_rows,
 count(*) FILTER (b0_close IS NOT NULL AND b1_close IS NOT NULL AND b1_change_30m IS NOT NULL AND b2_trades IS NOT NULL) AS b2_rows FROM nested GROUP BY 1,2""",
                               FEATURES_SQL, NESTED_SQL))
def _(spark, d):
    flags, reason = Q.nested_completeness([
        ("b0", F.col("b0_close").isNotNull()),
        ("b1", F.col("b1_close").isNotNull() & F.col("b1_change_30m").isNotNull()),
        ("b2", F.col("b2_trades").isNotNull())])
    f = nested(spark, d).select("*", *flags, reason.alias("reason"))
    return f.groupBy("asset", "reason").agg(
        F.count(F.lit(1)).alias("origins"), *[F.count_if(F.col(f"{b}_complete")).alias(f"{b}_rows") for b in ("b0", "b1", "b2")])


@query("set1_union_variants", sql("""
SELECT label, count(*) AS n, round(sum(v),4) AS total FROM (SELECT 'base' AS label, f_base AS v FROM panel UNION ALL SELECT 'wide', f_wide FROM panel) GROUP BY 1"""))
def _(spark, d):
    p = X.orders_series(spark, d)
    u = p.select(F.lit("base").alias("label"), F.col("f_base").alias("v")).unionByName(
        p.select(F.lit("wide").alias("label"), F.col("f_wide").alias("v")))
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("set2_deduplicate_events", sql("""
SELECT asset, executed_us, count(DISTINCT id) AS variants FROM tape GROUP BY 1,2"""))
def _(spark, d):
    t = X.tape(spark, d).select("asset", "executed_us", "id", "bid", "ask")
    return J.deduplicate_events(t.unionByName(t), ["asset", "executed_us", "id"]).groupBy("asset", "executed_us").agg(
        F.count(F.lit(1)).alias("variants"))


@query("set3_key_set_except", sql("""
SELECT asset, session_date::VARCHAR AS session_date FROM (SELECT asset, session_date FROM tape EXCEPT SELECT asset, session_date FROM origins)"""))
def _(spark, d):
    k = ["asset", "session_date"]
    return X.tape(spark, d).select(*k).subtract(X.origins(spark, d).select(*k))


@query("set4_pristine_split", sql("""
SELECT min(session_date)::VARCHAR AS start_date, max(session_date)::VARCHAR AS end_date, count(*) AS sessions FROM (
 SELECT session_date, rn - row_number() OVER (ORDER BY session_date) AS island FROM (
  SELECT session_date, row_number() OVER (ORDER BY session_date) AS rn, EXISTS (SELECT 1 FROM tape t
     WHERE t.session_date=c.session_date AND t.size>=99 AND t.asset='click' AND t.flags='sweep') AS exposed FROM cal c WHERE minutes>0)
 WHERE NOT exposed) GROUP BY island HAVING count(*)>=4 ORDER BY 1 LIMIT 1"""))
def _(spark, d):
    exposed = X.tape(spark, d).where((F.col("size") >= 99) & (F.col("asset") == "click") & (F.col("flags") == "sweep"))
    return J.pristine_run(X.calendar(spark, d).where(F.col("minutes") > 0), exposed, 4)

