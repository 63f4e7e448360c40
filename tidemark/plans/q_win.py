"""Queries over window functions and ordered recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import floor_div
from ..operators import features as FE
from ..operators import flow as FL
from ..operators import realized as RZ
from ..operators import robust as RB
from ..operators import series as SE
from . import panels as PN
from . import standin as X
from .q_flt import FEATURES_SQL, features
from .q_prj import ML
from .registry import query
from .standin import SERIES_SQL, sql

SES = "PARTITION BY asset, session_date ORDER BY bar"


@query("win1_log_returns", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, round(r,6) AS r FROM rets"""))
def _(spark, d):
    return PN.returns(spark, d).select("asset", "session_date", "bar", "r")


def fwd_sql(h):
    f = f"OVER ({SES} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    g = f"OVER ({SES} ROWS BETWEEN 2 FOLLOWING AND {h} FOLLOWING)"
    return f"""
    CASE WHEN count(r) {f}={h} THEN sum(r*r) {f} END AS rv_{h},
    CASE WHEN count(r) {f}={h} THEN pi()/2*coalesce(sum(adj) {g},0) END AS bv_{h},
    CASE WHEN count(r) {f}={h} THEN {h}/3.0::DOUBLE*sum(r*r*r*r) {f} END AS rq_{h},
    CASE WHEN count(r) {f}={h} THEN sum(CASE WHEN r>0 THEN r*r ELSE 0 END) {f} END AS up_{h},
    CASE WHEN count(r) {f}={h} THEN sum(CASE WHEN r<0 THEN r*r ELSE 0 END) {f} END AS down_{h}"""


FWD_SQL = f"""fwd AS (SELECT *, {fwd_sql(3)}, {fwd_sql(6)} FROM (SELECT *, abs(r)*abs(lag(r) OVER ({SES})) AS adj FROM rets))"""


def _rounded(h):
    return ", ".join(f"round({c}_{h},6) AS {c}_{h}" for c in ("rv", "bv", "rq", "up", "down")) + f""",
    round(CASE WHEN rv_{h} IS NOT NULL THEN greatest(rv_{h}-bv_{h},0) END,6) AS jump_{h}, round(rv_{h}-greatest(rv_{h}-bv_{h},0),6) AS cont_{h}"""


MEASURES = ["rv", "bv", "rq", "up", "down", "jump", "cont"]


@query("win2_forward_measures", sql(f"""
SELECT asset, session_date::VARCHAR AS session_date, bar, {_rounded(3)}, {_rounded(6)} FROM fwd""", FWD_SQL))
def _(spark, d):
    f = RZ.forward_measures(PN.returns(spark, d), [3, 6])
    return f.select("asset", "session_date", "bar", *[f"{m}_{h}" for h in (3, 6) for m in MEASURES])


BACK = f"OVER ({SES} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query("win3_backward_rv_and_noise", sql(f"""
SELECT asset, session_date::VARCHAR AS session_date, bar, round(rv,6) AS rv_back, CASE WHEN rv IS NOT NULL THEN round(sqrt(2*rq/6)/greatest(rv,1e-16),6) END AS noise FROM (
 SELECT *, CASE WHEN count(r) {BACK}=6 THEN sum(r*r) {BACK} END AS rv, CASE WHEN count(r) {BACK}=6 THEN 2.0::DOUBLE*sum(r*r*r*r) {BACK} END AS rq FROM rets)"""))
def _(spark, d):
    rv, rq = RZ.backward_rv(6), 2.0 * RZ.backward_sum(F.pow("r", 4.0), 6)
    r = PN.returns(spark, d).withColumn("rv_back", rv).withColumn("rq", rq)
    return r.select("asset", "session_date", "bar", "rv_back", RZ.relative_noise(F.col("rv_back"), F.col("rq"), 6).alias("noise"))


@query("win4_single_target", sql(f"""
SELECT asset, session_date::VARCHAR AS session_date, bar, seen AS price_count, CASE WHEN n<4 THEN 'SHORT_WINDOW' WHEN seen<4 THEN 'MISSING_PRICE' ELSE 'NONE' END AS reason,
 CASE WHEN n=4 AND seen=4 THEN round(rv,6) END AS target FROM (SELECT *, count(*) FILTER (observed) OVER w AS seen, count(close) OVER w AS n,
 sum(r*r) OVER ({SES} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS rv FROM rets WINDOW w AS ({SES} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))"""))
def _(spark, d):
    return RZ.single_target(PN.returns(spark, d), 3).select("asset", "session_date", "bar", "price_count", "reason", "target")


@query("win5_dense_grid", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, open, high, low, close, volume, observed, close IS NOT NULL AS valid, round(fill_share,6) AS fill_share FROM grid"""))
def _(spark, d):
    return PN.grid(spark, d).select("asset", "session_date", "bar", "open", "high", "low", "close", "volume", "observed", "valid", "fill_share")


DAYS_SQL = """days AS (SELECT asset, session_date, sum(r*r) AS day_rv FROM rets GROUP BY 1,2),
lags AS (SELECT *, lag(day_rv) OVER (PARTITION BY asset ORDER BY session_date) AS rv_prev_day,
  CASE WHEN count(day_rv) OVER w=5 THEN avg(day_rv) OVER w END AS rv_week FROM days
  WINDOW w AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


@query("win6_target_panel", sql(f"""
SELECT asset, session_date::VARCHAR AS session_date, bar, {_rounded(3)}, round(back3,6) AS rv_back_3, round(std,6) AS rv_session_to_date, round(rv_prev_day,6) AS rv_prev_day,
 round(sqrt(2*rq_3/3)/greatest(rv_3,1e-16),6) AS noise_3 FROM (SELECT *, CASE WHEN count(r) OVER b=3 THEN sum(r*r) OVER b END AS back3,
  sum(r*r) OVER (PARTITION BY asset, session_date ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS std FROM fwd
  WINDOW b AS ({SES} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) JOIN lags USING (asset, session_date) WHERE rv_3 IS NOT NULL AND back3 IS NOT NULL""", FWD_SQL, DAYS_SQL))
def _(spark, d):
    return PN.target_panel(spark, d, 3).select(
        "asset", "session_date", "bar", *[f"{m}_3" for m in MEASURES], "rv_back_3", "rv_session_to_date", "rv_prev_day", "noise_3")


B0_SQL = f"""b0 AS (SELECT asset, session_date, bar, rv_3 AS target, CASE WHEN count(r) OVER a=1 THEN sum(r*r) OVER a END AS rv_back_1, CASE WHEN count(r) OVER b=3 THEN sum(r*r) OVER b END AS rv_back_3,
 CASE WHEN count(r) OVER c=6 THEN sum(r*r) OVER c END AS rv_back_6, CASE WHEN count(r) OVER c=6 THEN 2.0::DOUBLE*sum(r*r*r*r) OVER c END AS rq_back_6,
 CASE WHEN count(r) OVER c=6 THEN sum(CASE WHEN r>0 THEN r*r ELSE 0 END) OVER c END AS rs_up_6, CASE WHEN count(r) OVER c=6 THEN sum(CASE WHEN r<0 THEN r*r ELSE 0 END) OVER c END AS rs_down_6,
 sum(r*r) OVER s AS rv_session_to_date, rv_prev_day, rv_week, CASE WHEN count(r) OVER a=1 THEN sum(r) OVER a END AS ret_1, CASE WHEN count(r) OVER c=6 THEN sum(r) OVER c END AS ret_6,
 CASE WHEN count(close) OVER c=6 THEN sum(pow(ln(high/low),2)/(4*ln(2))) OVER c END AS parkinson_6, CASE WHEN count(r) OVER c=6 THEN sum(volume) OVER c END AS volume_6,
 CASE WHEN count(r) OVER c=6 THEN sum(volume*close) OVER c END AS dollar_volume_6, bar*30 AS minutes_since_open, (slots-bar)*30 AS minutes_to_close, isodow(session_date) AS day_of_week
 FROM fwd JOIN lags USING (asset, session_date)
 WINDOW a AS ({SES} ROWS BETWEEN CURRENT ROW AND CURRENT ROW), b AS ({SES} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), c AS ({SES} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  s AS ({SES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
B0_NAMES = ["rv_back_1", "rv_back_3", "rv_back_6", "rq_back_6", "rs_up_6", "rs_down_6", "rv_session_to_date", "rv_prev_day", "rv_week",
            "ret_1", "ret_6", "parkinson_6", "dollar_volume_6"]


@query("win7_b0_panel", sql(f"""
SELECT asset, session_date::VARCHAR AS session_date, bar, {", ".join(f"round({c},6) AS {c}" for c in B0_NAMES)}, volume_6, minutes_since_open, minutes_to_close, day_of_week FROM b0
WHERE rv_back_6 IS NOT NULL""", FWD_SQL, DAYS_SQL, B0_SQL))
def _(spark, d):
    return PN.b0_panel(spark, d).where(F.col("rv_back_6").isNotNull()).select(
        "asset", "session_date", "bar", *B0_NAMES, "volume_6", "minutes_since_open", "minutes_to_close", "day_of_week")


EXACT_SQL = f"""exact AS (SELECT asset, session_date, bar, close, volume, count(*) FILTER (observed) OVER w AS have, sum(r*r) OVER v AS rv, sum(r) OVER v AS ret,
   sum(close*volume) OVER w AS dollar FROM rets WINDOW w AS ({SES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), v AS ({SES} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 gated AS (SELECT a.*, c.rv AS control_rv, CASE WHEN a.have<4 OR a.close IS NULL THEN 'HISTORY_MISSING' WHEN coalesce(c.have,0)<4 THEN 'CONTROL_MISSING' WHEN NOT a.dollar>0 THEN 'NO_VOLUME' ELSE 'NONE' END AS reason
   FROM exact a LEFT JOIN exact c ON c.asset='view' AND c.session_date=a.session_date AND c.bar=a.bar)"""


@query("win8_exact_window_features", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, reason, CASE WHEN reason='NONE' THEN round(rv,6) END AS rv, CASE WHEN reason='NONE' THEN round(ret,6) END AS ret,
 CASE WHEN reason='NONE' THEN round(ln(dollar),6) END AS log_dollar, CASE WHEN reason='NONE' THEN round(control_rv,6) END AS control_rv FROM gated""", EXACT_SQL))
def _(spark, d):
    return PN.exact_window(spark, d, 3, "view")


@query("win9_har_features", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, round(ln(greatest(rv_back_6,1e-12)),6) AS log_rv, round(ln(greatest(rv_session_to_date,1e-12)),6) AS log_rv_session,
 round(ln(greatest(rv_prev_day,1e-12)),6) AS log_rv_day, round(ln(greatest(rv_week,1e-12)),6) AS log_rv_week, round(bar/48.0::DOUBLE,6) AS minute_fraction,
 round(sqrt(greatest(rq_back_6,1e-12))/greatest(rv_back_6,1e-12)*ln(greatest(rv_back_6,1e-12)),6) AS harq FROM b0
WHERE rv_back_6 IS NOT NULL AND rv_prev_day IS NOT NULL AND rv_week IS NOT NULL""", FWD_SQL, DAYS_SQL, B0_SQL))
def _(spark, d):
    return PN.har_features(spark, d).select("asset", "session_date", "bar", "log_rv", "log_rv_session", "log_rv_day", "log_rv_week", "minute_fraction", "harq")


@query("win10_noise_robust_target", sql(f"""
SELECT asset, session_date::VARCHAR AS session_date, bar, round(CASE WHEN count(r) OVER f=6 THEN sum(r*r) OVER f + 2*coalesce(sum(p) OVER g,0) END,6) AS rv_ac1
FROM (SELECT *, r*lead(r) OVER ({SES}) AS p FROM rets) WINDOW f AS ({SES} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), g AS ({SES} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"""))
def _(spark, d):
    return RZ.noise_robust_target(PN.returns(spark, d), 6).select("asset", "session_date", "bar", "rv_ac1")


DELTA_SQL = """deltas AS (SELECT *, coalesce(iv-lag(iv) OVER w,0) AS d_iv, coalesce((mid-lag(mid) OVER w)/greatest(lag(mid) OVER w,1e-9),0) AS d_mid_rel,
  coalesce(rel_spread-lag(rel_spread) OVER w,0) AS d_spread, lag(id) OVER w IS NOT NULL AS has_previous
  FROM (SELECT *, (bid+ask)/2.0::DOUBLE AS mid, (ask-bid)/greatest((bid+ask)/2.0::DOUBLE,1e-9) AS rel_spread FROM tape)
  WINDOW w AS (PARTITION BY asset, contract ORDER BY created_us, id))"""


@query("win11_previous_trade_deltas", sql("""
SELECT id, round(d_iv,6) AS d_iv, round(d_mid_rel,6) AS d_mid_rel, round(d_spread,6) AS d_spread, has_previous FROM deltas""", DELTA_SQL))
def _(spark, d):
    return FE.previous_trade_deltas(X.tape(spark, d)).select("id", "d_iv", "d_mid_rel", "d_spread", "has_previous")


@query("win12_multileg_size", sql("SELECT id, multileg_size::DOUBLE AS multileg_size FROM ml", ML))
def _(spark, d):
    return FE.multileg_size(X.tape(spark, d)).select("id", "multileg_size")


EWMA_SQL = """ew0 AS (SELECT asset, session_date, bar, r*r AS sq, row_number() OVER (PARTITION BY asset ORDER BY session_date, bar) AS n FROM rets WHERE r IS NOT NULL),
 seed AS (SELECT asset, avg(sq) AS seed FROM ew0 WHERE n<=20 GROUP BY 1),
 ewma AS (SELECT e.asset, session_date, bar, CASE WHEN n>=20 THEN 6*(pow(0.97,n-20)*seed + pow(0.97,n-20)*sum(CASE WHEN n>20 THEN 0.03*sq*pow(0.97,-(n-20)) ELSE 0 END)
   OVER (PARTITION BY e.asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS ewma FROM (SELECT *, n::DOUBLE FROM ew0) e JOIN seed s ON s.asset=e.asset)"""


@query("win13_ewma_variance", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, round(ewma,6) AS ewma FROM ewma""", EWMA_SQL))
def _(spark, d):
    return RZ.ewma_states(PN.returns(spark, d), 0.97, 20, 6)


@query("win14_decay_intensity", sql("""
SELECT o.origin_id, round(coalesce(sum(exp(-greatest(o.origin_us-120000000-executed_us,0)/1e6::DOUBLE/3600)) FILTER (t.id IS NOT NULL),0),6) AS intensity,
 round(coalesce(sum(exp(-greatest(o.origin_us-120000000-executed_us,0)/1e6::DOUBLE/3600)) FILTER (t.id IS NOT NULL),0)
  - coalesce(sum(exp(-greatest(o.origin_us-3720000000-executed_us,0)/1e6::DOUBLE/3600)) FILTER (created_us<=o.origin_us-3720000000),0),6) AS innovation
FROM origins o LEFT JOIN tape t ON t.asset=o.asset AND t.session_date=o.session_date AND t.created_us<=o.origin_us-120000000 GROUP BY 1"""))
def _(spark, d):
    o = X.origins(spark, d).withColumn("k", floor_div(F.col("origin_us"), X.SLOT_US)).select("origin_id", "asset", "session_date", "k")
    return FL.decay_intensity(X.tape(spark, d), X.SLOT_US, 120, 3600.0, o, 2).select("origin_id", "intensity", "innovation")


def banded(spark, d):
    f = features(spark, d)
    return f.select("origin_id", "asset", "session_date", F.floor(F.col("minute") / 240).cast("bigint").alias("band"),
                    F.log1p(F.coalesce("b2_trades", F.lit(0)).cast("double")).alias("x"))


@query("win15_prior_session_deviation", sql("""
SELECT origin_id, round(CASE WHEN hist<10 OR scale=0 THEN 0 ELSE (x-center)/scale END,6) AS deviation, hist AS history_sessions, hist>=10 AS complete,
 CASE WHEN hist<10 THEN 'INSUFFICIENT' WHEN center IS NULL THEN 'CONSTANT' WHEN bs>0 THEN bl WHEN ws>0 THEN 'ASSET' ELSE 'CONSTANT' END AS label FROM (
 SELECT o.*, d.r-1 AS hist, b.center, b.bs, b.bl, w.ws, CASE WHEN b.center IS NULL THEN 0 WHEN b.bs>0 THEN b.bs ELSE coalesce(w.ws,0) END AS scale
 FROM xs o JOIN dr d USING (asset, session_date)
 LEFT JOIN (SELECT asset, session_date, band, median AS center, CASE WHEN mad>0 THEN 1.4826*mad WHEN n>=2 AND iqr>0 THEN iqr/1.349 ELSE 0 END AS bs,
    CASE WHEN mad>0 THEN 'MAD' WHEN n>=2 AND iqr>0 THEN 'IQR' ELSE 'CONSTANT' END AS bl FROM bandfit) b USING (asset, session_date, band)
 LEFT JOIN (SELECT asset, session_date, CASE WHEN mad>0 THEN 1.4826*mad WHEN n>=2 AND iqr>0 THEN iqr/1.349 ELSE 0 END AS ws FROM wholefit) w USING (asset, session_date))""",
    """xs AS (SELECT o.origin_id, o.asset, o.session_date, o.minute//240 AS band, ln(1+count(t.id)) AS x FROM origins o LEFT JOIN tape t ON t.asset=o.asset
      AND (t.executed_us//1800000000+1)*1800000000=o.origin_us GROUP BY ALL),
 dr AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY session_date) AS r FROM (SELECT DISTINCT asset, session_date FROM xs)),
 xr AS (SELECT * FROM xs JOIN dr USING (asset, session_date)),
 bandh AS (SELECT c.asset, c.session_date, c.band, h.x FROM (SELECT DISTINCT asset, session_date, band, r FROM xr) c JOIN xr h ON h.asset=c.asset AND h.band=c.band AND h.r<c.r AND h.r>=c.r-60),
 bandm AS (SELECT asset, session_date, band, median(x) AS median, count(*) n, quantile_cont(x,0.75)-quantile_cont(x,0.25) AS iqr FROM bandh GROUP BY 1,2,3),
 bandfit AS (SELECT m.asset, m.session_date, m.band, m.median, m.n, m.iqr, median(abs(h.x-m.median)) AS mad FROM bandm m JOIN bandh h USING (asset, session_date, band) GROUP BY ALL),
 wholeh AS (SELECT c.asset, c.session_date, h.x FROM dr c JOIN xr h ON h.asset=c.asset AND h.r<c.r AND h.r>=c.r-60),
 wholem AS (SELECT asset, session_date, median(x) AS median, count(*) n, quantile_cont(x,0.75)-quantile_cont(x,0.25) AS iqr FROM wholeh GROUP BY 1,2),
 wholefit AS (SELECT m.asset, m.session_date, m.n, m.iqr, median(abs(h.x-m.median)) AS mad FROM wholem m JOIN wholeh h USING (asset, session_date) GROUP BY ALL)"""))
def _(spark, d):
    return RB.prior_session_deviation(banded(spark, d), "x", 60, 10).select(
        "origin_id", "deviation", "history_sessions", "complete", "label")


CAL_SQL = """cal_in AS (SELECT asset||'|B'||(minute//360)::VARCHAR AS key, origin_id, ln(1+coalesce(b2_trades,0)) AS f1, ln(1+coalesce(b0_close,0)) AS f2, ln(1+coalesce(b1_close,0)) AS f3 FROM feat),
 cm AS (SELECT key, median(f1) m1, median(f2) m2, median(f3) m3, quantile_cont(f1,.75)-quantile_cont(f1,.25) i1, quantile_cont(f2,.75)-quantile_cont(f2,.25) i2, quantile_cont(f3,.75)-quantile_cont(f3,.25) i3 FROM cal_in GROUP BY 1),
 cs AS (SELECT key, m1,m2,m3, CASE WHEN a1>0 THEN 1.4826*a1 WHEN i1>0 THEN i1/1.349 ELSE 1 END s1, CASE WHEN a2>0 THEN 1.4826*a2 WHEN i2>0 THEN i2/1.349 ELSE 1 END s2, CASE WHEN a3>0 THEN 1.4826*a3 WHEN i3>0 THEN i3/1.349 ELSE 1 END s3
  FROM (SELECT key, m1,m2,m3,i1,i2,i3, median(abs(f1-m1)) a1, median(abs(f2-m2)) a2, median(abs(f3-m3)) a3 FROM cal_in JOIN cm USING (key) GROUP BY ALL)),
 csc AS (SELECT key, origin_id, coalesce(median(z),0) AS score FROM (SELECT key, origin_id, unnest([(f1-m1)/s1,(f2-m2)/s2,(f3-m3)/s3]) AS z FROM cal_in JOIN cs USING (key)) WHERE z>0 GROUP BY 1,2),
 csall AS (SELECT c.key, c.origin_id, coalesce(s.score,0) AS score FROM cal_in c LEFT JOIN csc s USING (key, origin_id)),
 cut AS (SELECT key, quantile_cont(score,0.95) AS threshold FROM csall GROUP BY 1)"""


def _calib_input(spark, d):
    return features(spark, d).select(
        "origin_id", F.concat(F.col("asset"), F.lit("|B"), F.floor(F.col("minute") / 360)).alias("key"),
        F.col("b2_trades").cast("double").alias("f1"), F.col("b0_close").alias("f2"), F.col("b1_close").alias("f3"))


@query("win16_frozen_calibration", sql("""
SELECT origin_id, round(score,6) AS score, score>=threshold AS unusual FROM csall JOIN cut USING (key)""", FEATURES_SQL, CAL_SQL))
def _(spark, d):
    p = _calib_input(spark, d)
    names = ["f1", "f2", "f3"]
    out = RB.apply_calibration(p, RB.frozen_calibration(p, "key", names), "key", names)
    return out.select("origin_id", "score", "unusual")


@query("win17_one_session_lag", sql("""
SELECT * FROM (SELECT origin_id, lag(n) OVER (PARTITION BY asset, minute ORDER BY session_date) AS n FROM
 (SELECT o.origin_id, o.asset, o.minute, o.session_date, count(t.id) AS n FROM origins o LEFT JOIN tape t ON t.asset=o.asset AND (t.executed_us//1800000000+1)*1800000000=o.origin_us GROUP BY ALL)) WHERE n IS NOT NULL"""))
def _(spark, d):
    f = features(spark, d).select("origin_id", "asset", "minute", "session_date", F.coalesce("b2_trades", F.lit(0).cast("bigint")).alias("n"))
    return SE.one_session_lag(f, ["asset", "minute"], ["n"]).select("origin_id", "n")


@query("win18_chronological_split", sql("""
SELECT session_date::VARCHAR AS session_date, dense_rank() OVER (ORDER BY session_date)-1 AS session_index, count(*) AS rows,
 dense_rank() OVER (ORDER BY session_date)-1 < floor(0.7*count(*) OVER ()) AS is_train FROM panel GROUP BY session_date"""))
def _(spark, d):
    p = X.orders_series(spark, d).select("origin_id", "session_date")
    return SE.chronological_split(p, 0.7).groupBy("session_date", "session_index", "is_train").agg(F.count(F.lit(1)).alias("rows"))


@query("win19_counting_windows", sql("""
SELECT o.origin_id, count(t.id) AS trades, count(t.id) FILTER (expiry=t.session_date) AS zero_dte_trades, 0::BIGINT AS violations,
 round(coalesce(avg((created_us-executed_us)/1e6::DOUBLE),0),6) AS mean_latency_s, round(coalesce(quantile_cont((created_us-executed_us)/1e6::DOUBLE,0.95),0),6) AS p95_latency_s
FROM origins o LEFT JOIN tape t ON t.asset=o.asset AND t.session_date=o.session_date AND t.created_us<=o.origin_us-120000000
 AND (o.minute=30 OR t.created_us>o.origin_us-120000000-1800000000) GROUP BY 1"""))
def _(spark, d):
    return FL.counting_windows(X.tape(spark, d), X.origins(spark, d), X.SLOT_US, 120)


@query("win20_drawdown", sql("""
SELECT series, idx, round(equity,6) AS equity, round(equity-max(equity) OVER (PARTITION BY series ORDER BY idx),6) AS drawdown FROM
 (SELECT *, sum(value) OVER (PARTITION BY series ORDER BY idx) AS equity FROM series)""", SERIES_SQL))
def _(spark, d):
    return SE.drawdown(X.loss_series(spark, d), ["series"], "idx", "value").select("series", "idx", "equity", "drawdown")


@query("win21_autocorrelation", sql("""
SELECT series, n, round(acf_1,6) AS acf_1, round(acf_2,6) AS acf_2, round(lb,6) AS ljung_box, round(exp(-lb/2),6) AS p_value FROM (
 SELECT series, count(*) AS n, sum(c*l1)/sum(c*c) AS acf_1, sum(c*l2)/sum(c*c) AS acf_2,
  count(*)*(count(*)+2.0::DOUBLE)*(pow(sum(c*l1)/sum(c*c),2)/(count(*)-1)+pow(sum(c*l2)/sum(c*c),2)/(count(*)-2)) AS lb FROM
 (SELECT *, lag(c,1) OVER w AS l1, lag(c,2) OVER w AS l2 FROM (SELECT *, value-avg(value) OVER (PARTITION BY series) AS c FROM series) WINDOW w AS (PARTITION BY series ORDER BY idx)) GROUP BY 1)""", SERIES_SQL))
def _(spark, d):
    return SE.autocorrelation(X.loss_series(spark, d), ["series"], 2)


@query("win22_delayed_snapshots", sql("""
SELECT o.origin_id, s.dly AS delay, b.bar AS source_bar, b.close AS spot, round(b.rv,6) AS rv_lag FROM origins o CROSS JOIN (VALUES (1::BIGINT),(2::BIGINT)) s(dly)
ASOF LEFT JOIN (SELECT asset, session_date, bar, close, sum(r*r) OVER (PARTITION BY asset, session_date ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rv FROM
  (SELECT *, ln(close/lag(close) OVER (PARTITION BY asset, session_date ORDER BY bar)) AS r FROM bars)) b
 ON b.asset=o.asset AND b.session_date=o.session_date AND o.minute//30 - s.dly >= b.bar"""))
def _(spark, d):
    return PN.delayed_snapshots(spark, d, [1, 2], 5)

