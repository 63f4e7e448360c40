"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import latency_seconds, qlike, with_scalars
from ..functions.time import expiry_close, session_tercile
from ..operators import diagnostics as DG
from ..operators import evaluate as EV
from ..operators import flow as FL
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import quantiles as QT
from ..operators import ranks as RK
from ..operators import surface as SF
from ..sources.tape import partition_inventory
from . import panels as PN
from . import standin as X
from .q_flt import FEATURES_SQL, features
from .q_jn import PAIRS_SQL, nested, NESTED_SQL, pairs
from .q_win import DELTA_SQL
from .registry import query
from .standin import sql

STEP = X.SLOT_US
HOUR = 3_600_000_000


def elig(delay_us: int, panes: int = 4) -> str:
    return f"""elig AS (SELECT o.origin_id, o.origin_us, o.session_date AS odate, t.*, greatest(t.premium,0) AS p FROM origins o JOIN tape t ON t.asset=o.asset
      AND t.executed_us >= o.origin_us-{delay_us}-{panes}*1800000000::BIGINT AND t.executed_us < o.origin_us-{delay_us} AND t.created_us <= o.origin_us-{delay_us})"""


ACT_SQL = """act AS (SELECT o.origin_id, count(e.id) AS trades, count(DISTINCT e.contract) AS contracts, coalesce(sum(e.p),0) AS total_premium, coalesce(max(e.p),0) AS max_premium,
   coalesce(sum(e.p) FILTER (option_type='call'),0) AS call_premium, coalesce(sum(e.p) FILTER (option_type='put'),0) AS put_premium,
   coalesce(sum(e.p) FILTER (tags='ask_side')/sum(e.p),0) AS ask_share, coalesce(sum(e.p) FILTER (tags='bid_side')/sum(e.p),0) AS bid_share, max(e.created_us) AS max_created_us
  FROM origins o LEFT JOIN elig e USING (origin_id) GROUP BY 1),
 rep AS (SELECT origin_id, sum(p) AS repeated_premium, sum(n) AS repeated_trades FROM (SELECT origin_id, contract, count(*) n, sum(p) p FROM elig GROUP BY 1,2) WHERE n>1 GROUP BY 1),
 con AS (SELECT origin_id, max(n)/sum(n)::DOUBLE AS strike_concentration FROM (SELECT origin_id, strike, count(*) n FROM elig GROUP BY 1,2) GROUP BY 1),
 exc AS (SELECT origin_id, max(n)/sum(n)::DOUBLE AS expiry_concentration FROM (SELECT origin_id, expiry, count(*) n FROM elig GROUP BY 1,2) GROUP BY 1)"""


def activity(spark, d, delays):
    return FL.activity(X.tape(spark, d), X.origins(spark, d), STEP, 4, delays)


@query("agg1_activity", sql("""
SELECT origin_id, trades, contracts, round(total_premium,4) AS total_premium, max_premium, round(call_premium,4) AS call_premium, round(put_premium,4) AS put_premium,
 round(ask_share,6) AS ask_share, round(bid_share,6) AS bid_share, max_created_us FROM act""", elig(60000000), ACT_SQL))
def _(spark, d):
    return activity(spark, d, [60]).select(
        "origin_id", "trades", "contracts", *[F.round(c, 4).alias(c) for c in ("total_premium", "call_premium", "put_premium")],
        "max_premium", "ask_share", "bid_share", "max_created_us")


@query("prj16_compact_features", sql("""
SELECT origin_id, round(ln(1+trades),6) AS log_trades, round(CASE WHEN trades>0 THEN contracts/trades::DOUBLE ELSE 0 END,6) AS unique_share,
 round(CASE WHEN trades>0 THEN ln(1+total_premium/trades) ELSE 0 END,6) AS log_mean_premium, round(ln(1+max_premium),6) AS log_max_premium,
 round(CASE WHEN call_premium+put_premium>0 THEN (call_premium-put_premium)/(call_premium+put_premium) ELSE 0 END,6) AS call_put_imbalance,
 round(ask_share-bid_share,6) AS side_imbalance, round(CASE WHEN total_premium>0 THEN coalesce(repeated_premium,0)/total_premium ELSE 0 END,6) AS repeated_share,
 round(coalesce(strike_concentration,0),6) AS strike_concentration, round(coalesce(expiry_concentration,0),6) AS expiry_concentration
FROM act LEFT JOIN rep USING (origin_id) LEFT JOIN con USING (origin_id) LEFT JOIN exc USING (origin_id)""", elig(60000000), ACT_SQL))
def _(spark, d):
    return FL.compact_features(activity(spark, d, [60])).drop("asset", "session_date", "minute")


def _wide_sql(delay):
    return f"""SELECT o.origin_id, {delay}::BIGINT AS delay_s, count(e.id) AS trades, coalesce(sum(e.size),0)::BIGINT AS total_size, coalesce(max(e.size),0) AS max_size,
 round(coalesce(sum(e.premium) FILTER (bid>0 AND ask>bid)/sum(e.premium),0),6) AS midpoint_share, 0.0::DOUBLE AS multileg_share,
 round(coalesce(avg((e.flags='sweep')::INT),0),6) AS sweep_share, CASE WHEN count(e.iv)>=2 THEN round(max(e.iv)-min(e.iv),6) END AS iv_range,
 CASE WHEN count(e.id)>0 THEN 1.0::DOUBLE ELSE 0 END AS valid_share, CASE WHEN count(e.id)>0 THEN 0.0::DOUBLE ELSE 1 END AS missing_iv_share,
 round(quantile_cont(e.iv,0.5),6) AS iv_median, round(coalesce(quantile_cont(abs(e.strike/m.spot-1),0.5),0),6) AS abs_moneyness_median,
 round(coalesce(quantile_cont((e.expiry-o.session_date)::DOUBLE,0.5),0),6) AS dte_median
FROM origins o LEFT JOIN (SELECT asset, session_date, (bar+1)*30 AS minute, close AS spot FROM grid) m ON m.asset=o.asset AND m.session_date=o.session_date AND m.minute=o.minute
LEFT JOIN (SELECT o.origin_id AS oid, t.* FROM origins o JOIN tape t ON t.asset=o.asset AND t.executed_us >= o.origin_us-{delay}000000-7200000000 AND t.executed_us < o.origin_us-{delay}000000
   AND t.created_us <= o.origin_us-{delay}000000) e ON e.oid=o.origin_id GROUP BY 1"""


def spot_origins(spark, d):
    spot = PN.grid(spark, d).select("asset", "session_date", ((F.col("bar") + 1) * 30).alias("minute"), F.col("close").alias("spot"))
    return X.origins(spark, d).join(spot, ["asset", "session_date", "minute"], "left")


@query("agg2_wide_activity", sql(" UNION ALL ".join(_wide_sql(x) for x in (60, 120, 300))))
def _(spark, d):
    return FL.wide_activity(X.tape(spark, d), spot_origins(spark, d), STEP, 4, [60, 120, 300])


@query("agg3_nested_concentration", sql("""
SELECT o.origin_id, round(coalesce(repeated_premium,0),4) AS repeated_premium, coalesce(repeated_trades,0)::BIGINT AS repeated_trades,
 round(coalesce(strike_concentration,0),6) AS strike_concentration, round(coalesce(expiry_concentration,0),6) AS expiry_concentration
FROM origins o LEFT JOIN rep USING (origin_id) LEFT JOIN con USING (origin_id) LEFT JOIN exc USING (origin_id)""", elig(60000000), ACT_SQL))
def _(spark, d):
    return activity(spark, d, [60]).select("origin_id", F.round("repeated_premium", 4).alias("repeated_premium"), "repeated_trades",
                                           "strike_concentration", "expiry_concentration")


def erf_sql(x):
    return (f"(sign({x})*(1-((((1.061405429*(1/(1+0.3275911*abs({x})))-1.453152027)*(1/(1+0.3275911*abs({x})))+1.421413741)*(1/(1+0.3275911*abs({x})))"
            f"-0.284496736)*(1/(1+0.3275911*abs({x})))+0.254829592)*(1/(1+0.3275911*abs({x})))*exp(-({x})*({x}))))").replace("1.061405429", "1.061405429::DOUBLE")


def ncdf_sql(x):
    return f"(0.5*(1+{erf_sql(f'(({x})/sqrt(2.0::DOUBLE))')}))"


MARK_SQL = """marks AS (SELECT asset, session_date, bar, CASE WHEN bar=0 THEN open ELSE lag(close) OVER (PARTITION BY asset, session_date ORDER BY bar) END AS mark FROM grid),
mtape AS (SELECT t.*, 90.0::DOUBLE+20.0::DOUBLE*m.mark/(m.mark+20.0::DOUBLE) AS mark, coalesce(c.open_us+c.minutes*60000000, epoch_us(t.expiry::TIMESTAMP)+57600000000) AS expiry_close_us
  FROM (SELECT *, (executed_us%86400000000)//1800000000 AS bar FROM tape) t JOIN marks m USING (asset, session_date, bar)
  LEFT JOIN cal c ON c.session_date=t.expiry AND c.minutes>0 WHERE m.mark>0)"""

CH_SQL = f"""ch0 AS (SELECT *, (bid+ask)/2.0::DOUBLE AS mid, greatest(0, least(size, coalesce(multi_vol - lag(multi_vol) OVER w, 0))) AS multileg_size,
   (ask-bid)/greatest((bid+ask)/2.0::DOUBLE,1e-9) AS rel_spread, (expiry_close_us-executed_us)/1e6::DOUBLE/(365.25::DOUBLE*86400) AS tenor
   FROM mtape WINDOW w AS (PARTITION BY asset, contract ORDER BY created_us, id)),
 ch1 AS (SELECT *, CASE WHEN multileg_size>0 THEN 0 WHEN tags='ask_side' THEN 1 WHEN tags='bid_side' THEN -1 ELSE 0 END::DOUBLE AS dir,
   coalesce(iv-lag(iv) OVER w,0) AS d_iv, coalesce((mid-lag(mid) OVER w)/greatest(lag(mid) OVER w,1e-9),0) AS d_mid_rel, coalesce(rel_spread-lag(rel_spread) OVER w,0) AS d_spread,
   (lag(id) OVER w IS NOT NULL)::INT AS previous, CASE WHEN tenor>0 THEN tenor ELSE 60.0::DOUBLE/(365.25::DOUBLE*24*3600) END AS ten,
   greatest(least(iv,5),0.01) AS sig FROM ch0 WINDOW w AS (PARTITION BY asset, contract ORDER BY created_us, id)),
 ch2 AS (SELECT *, (ln(greatest(mark,1e-9)/greatest(strike,1e-9))+0.5*sig*sig*ten)/(sig*sqrt(ten)) AS d1 FROM ch1),
 ch3 AS (SELECT *, exp(-0.5*d1*d1)/sqrt(2*pi()) AS pdf, {ncdf_sql('d1')} - CASE WHEN option_type='call' THEN 0 ELSE 1 END AS delta FROM ch2),
 ch AS (SELECT *, pdf/(greatest(mark,1e-9)*sig*sqrt(ten)) AS gamma, greatest(mark,1e-9)*pdf*sqrt(ten) AS vega, size*100.0::DOUBLE*dir AS w,
   expiry=session_date AS zero, ln(greatest(strike,1e-9)/greatest(mark,1e-9)) AS lm, (created_us-executed_us)/1e6::DOUBLE AS lat FROM ch3)"""


def flow_sql(panes):
    return f"""frow AS (SELECT o.origin_id, o.origin_us, c.* FROM origins o JOIN ch c ON c.asset=o.asset AND c.created_us<=o.origin_us-120000000 AND c.executed_us>=o.origin_us-120000000-{panes}*1800000000::BIGINT)"""


FLOW_COLS = """count(f.id) AS trades, count(DISTINCT f.contract) AS contracts, round(coalesce(sum(size),0),4)::DOUBLE AS size, round(coalesce(sum(premium),0),4) AS premium,
 round(coalesce(sum(vega*w),0),3) AS vega_flow, round(coalesce(sum(gamma*w*mark*mark),0),3) AS gamma_flow, round(coalesce(sum(delta*w*mark),0),3) AS delta_flow,
 round(coalesce(sum(abs(vega*size*100)),0),3) AS vega_flow_abs, round(coalesce(sum(vega*w) FILTER (option_type='call'),0),3) AS vega_flow_call, round(coalesce(sum(vega*w) FILTER (option_type='put'),0),3) AS vega_flow_put,
 round(coalesce(sum(vega*w) FILTER (tenor<=7/365.25::DOUBLE),0),3) AS vega_flow_short_dte, round(coalesce(sum(vega*w) FILTER (tenor>30/365.25::DOUBLE),0),3) AS vega_flow_long_dte,
 round(coalesce(sum(premium) FILTER (CASE WHEN option_type='call' THEN lm>0.02 ELSE lm<-0.02 END),0)/greatest(coalesce(sum(premium),0),1e-9),6) AS otm_premium_share,
 round(coalesce(sum(premium) FILTER (dir>0),0)/greatest(coalesce(sum(premium),0),1e-9),6) AS buy_premium_share, round(coalesce(sum(premium) FILTER (dir<0),0)/greatest(coalesce(sum(premium),0),1e-9),6) AS sell_premium_share,
 round(coalesce(sum(premium) FILTER (dir=0),0)/greatest(coalesce(sum(premium),0),1e-9),6) AS passive_premium_share, round(coalesce(sum(premium) FILTER (flags='sweep'),0)/greatest(coalesce(sum(premium),0),1e-9),6) AS sweep_premium_share,
 round(coalesce(sum(premium) FILTER (multileg_size>0),0)/greatest(coalesce(sum(premium),0),1e-9),6) AS multileg_premium_share, round(coalesce(sum(premium) FILTER (zero),0)/greatest(coalesce(sum(premium),0),1e-9),6) AS zero_dte_premium_share,
 round(coalesce(sum(multileg_size),0)/greatest(coalesce(sum(size),0),1e-9),6) AS multileg_size_share,
 round(coalesce(sum(d_iv),0)/greatest(coalesce(sum(previous),0),1),6) AS d_iv, round(coalesce(sum(d_mid_rel),0)/greatest(coalesce(sum(previous),0),1),6) AS d_mid_rel, round(coalesce(sum(d_spread),0)/greatest(coalesce(sum(previous),0),1),6) AS d_spread,
 round(coalesce((max(executed_us)-min(executed_us))/1e6::DOUBLE,0),6) AS observed_span_s, CASE WHEN count(f.id)=0 THEN 1.0::DOUBLE ELSE 0 END AS is_empty_window,
 round(coalesce(avg((o.origin_us-120000000-created_us)/1e6::DOUBLE),0),1) AS mean_age_s, round(coalesce(avg(lat),0),6) AS mean_provider_latency_s, round(coalesce(avg((lat>60)::INT),0),6) AS late_arrival_share,
 round(coalesce(quantile_cont(lat,0.95),0),6) AS p95_provider_latency_s, round(coalesce(sum(premium*dir) FILTER (zero),0),4) AS zero_dte_signed_premium, round(coalesce(avg(zero::INT),0),6) AS zero_dte_trade_share"""

HHI_SQL = """hh AS (SELECT origin_id, CASE WHEN count(*)>=2 THEN (sum(w*w)/pow(sum(w),2)-1.0::DOUBLE/count(*))/(1-1.0::DOUBLE/count(*)) END AS strike_hhi FROM (SELECT origin_id, strike, sum(premium) w FROM frow GROUP BY 1,2) WHERE w>0 GROUP BY 1),
 he AS (SELECT origin_id, CASE WHEN count(*)>=2 THEN (sum(w*w)/pow(sum(w),2)-1.0::DOUBLE/count(*))/(1-1.0::DOUBLE/count(*)) END AS expiry_hhi FROM (SELECT origin_id, expiry, sum(premium) w FROM frow GROUP BY 1,2) WHERE w>0 GROUP BY 1),
 en AS (SELECT origin_id, CASE WHEN count(*)>=2 THEN (ln(sum(w))-sum(w*ln(w))/sum(w))/ln(count(*)) END AS contract_entropy FROM (SELECT origin_id, contract, sum(premium) w FROM frow GROUP BY 1,2) WHERE w>0 GROUP BY 1),
 ga AS (SELECT origin_id, CASE WHEN count(g)>0 AND avg(g)>0 THEN stddev_pop(g)/avg(g) END AS interarrival_cv FROM (SELECT origin_id, (executed_us-lag(executed_us) OVER (PARTITION BY origin_id ORDER BY executed_us, id))/1e6::DOUBLE AS g FROM frow) GROUP BY 1)"""


def flow_tape(spark, d):
    return expiry_close(PN.chain_tape(spark, d), X.calendar(spark, d), "expiry", 960)


FLOW_DIGITS = {"mean_age_s": 1, **dict.fromkeys(("size", "premium", "zero_dte_signed_premium"), 4),
               **dict.fromkeys(("vega_flow", "gamma_flow", "delta_flow", "vega_flow_abs", "vega_flow_call", "vega_flow_put",
                                "vega_flow_short_dte", "vega_flow_long_dte"), 3)}


def flow(spark, d, panes, concentration):
    f = FL.flow_record(flow_tape(spark, d), X.origins(spark, d), STEP, panes, 120, concentration)
    return f.drop("asset", "session_date", "minute").withColumns({c: F.round(c, n) for c, n in FLOW_DIGITS.items()})


@query("agg4_flow_record_short", sql(f"""
SELECT o.origin_id, {FLOW_COLS}, round(count(f.id)/1800.0::DOUBLE,6) AS rate_per_second FROM origins o LEFT JOIN frow f USING (origin_id) GROUP BY 1""",
                                     MARK_SQL, CH_SQL, flow_sql(1)))
def _(spark, d):
    return flow(spark, d, 1, False)


@query("agg4_flow_record_long", sql(f"""
SELECT m.*, CASE WHEN trades=0 THEN 0 ELSE round(strike_hhi,6) END AS strike_hhi, CASE WHEN trades=0 THEN 0 ELSE round(expiry_hhi,6) END AS expiry_hhi,
 CASE WHEN trades=0 THEN 0 ELSE round(contract_entropy,6) END AS contract_entropy, CASE WHEN trades=0 THEN 0 ELSE round(interarrival_cv,6) END AS interarrival_cv FROM
 (SELECT o.origin_id, {FLOW_COLS}, round(count(f.id)/10800.0::DOUBLE,6) AS rate_per_second FROM origins o LEFT JOIN frow f USING (origin_id) GROUP BY 1) m
 LEFT JOIN hh USING (origin_id) LEFT JOIN he USING (origin_id) LEFT JOIN en USING (origin_id) LEFT JOIN ga USING (origin_id)""",
                                    MARK_SQL, CH_SQL, flow_sql(6), HHI_SQL))
def _(spark, d):
    return flow(spark, d, 6, True)


@query("agg5_herfindahl", sql("""
SELECT asset, session_date::VARCHAR AS session_date, round(sum(w*w)/pow(sum(w),2),6) AS hhi, CASE WHEN count(*)>=2 THEN round((sum(w*w)/pow(sum(w),2)-1.0::DOUBLE/count(*))/(1-1.0::DOUBLE/count(*)),6) END AS hhi_normalised
FROM (SELECT asset, session_date, contract, sum(premium) w FROM tape GROUP BY 1,2,3) WHERE w>0 GROUP BY 1,2"""))
def _(spark, d):
    w = X.tape(spark, d).groupBy("asset", "session_date", "contract").agg(F.sum("premium").alias("w"))
    return w.groupBy("asset", "session_date").agg(FL.herfindahl(F.col("w"), False).alias("hhi"), FL.herfindahl(F.col("w")).alias("hhi_normalised"))


@query("agg6_entropy", sql("""
SELECT asset, session_date::VARCHAR AS session_date, round(ln(sum(w))-sum(w*ln(w))/sum(w),6) AS entropy, CASE WHEN count(*)>=2 THEN round((ln(sum(w))-sum(w*ln(w))/sum(w))/ln(count(*)),6) END AS entropy_normalised
FROM (SELECT asset, session_date, contract, sum(premium) w FROM tape GROUP BY 1,2,3) WHERE w>0 GROUP BY 1,2"""))
def _(spark, d):
    w = X.tape(spark, d).groupBy("asset", "session_date", "contract").agg(F.sum("premium").alias("w"))
    return w.groupBy("asset", "session_date").agg(FL.entropy(F.col("w"), False).alias("entropy"), FL.entropy(F.col("w")).alias("entropy_normalised"))


@query("agg7_burstiness", sql("""
SELECT asset, session_date::VARCHAR AS session_date, count(*) AS events, CASE WHEN count(*)>=3 THEN round(count(*)/((max(executed_us)-min(executed_us))/1e6::DOUBLE),6) END AS rate_per_second,
 CASE WHEN count(*)>=3 THEN round(stddev_pop(g)/avg(g),6) END AS interarrival_cv, CASE WHEN count(*)>=3 THEN round(quantile_cont(g,0.5),6) END AS interarrival_median FROM
 (SELECT *, (executed_us-lag(executed_us) OVER (PARTITION BY asset, session_date ORDER BY executed_us, id))/1e6::DOUBLE AS g FROM tape) GROUP BY 1,2"""))
def _(spark, d):
    return FL.burstiness(X.tape(spark, d), ["asset", "session_date"], "executed_us", HOUR)


@query("agg8_quote_impact", sql("""
SELECT asset, session_date::VARCHAR AS session_date, round(avg(d_iv),6) AS d_iv, round(avg(d_mid_rel),6) AS d_mid_rel, round(avg(d_spread),6) AS d_spread, count(*) AS pairs FROM deltas WHERE has_previous GROUP BY 1,2""", DELTA_SQL))
def _(spark, d):
    return FL.quote_impact(X.tape(spark, d), ["asset", "session_date"])


LAT = "(created_us-executed_us)/1e6::DOUBLE"
HIST_SQL = f"""hist AS (SELECT asset, session_date, CAST(floor((log10({LAT})+4)*200) AS BIGINT) AS bin, count(*) AS n FROM tape WHERE {LAT}>0 GROUP BY 1,2,3)"""


def lat():
    return latency_seconds(F.col("created_us"), F.col("executed_us"))


@query("agg9_latency_histogram", sql("SELECT asset, session_date::VARCHAR AS session_date, bin, n FROM hist", HIST_SQL))
def _(spark, d):
    return QT.latency_histogram(X.tape(spark, d), ["asset", "session_date"], lat())


@query("agg10_pooled_quantile", sql("""
SELECT asset, round(pow(10, bin/200.0::DOUBLE-4+(target-(cum-n))/n/200.0::DOUBLE),6) AS p95_s FROM (
 SELECT *, row_number() OVER (PARTITION BY asset ORDER BY bin) rn FROM (SELECT asset, bin, n, sum(n) OVER (PARTITION BY asset ORDER BY bin) AS cum, 0.95::DOUBLE*sum(n) OVER (PARTITION BY asset) AS target
  FROM (SELECT asset, bin, sum(n) AS n FROM hist GROUP BY 1,2)) WHERE cum>=target) WHERE rn=1""", HIST_SQL))
def _(spark, d):
    parts = QT.latency_histogram(X.tape(spark, d), ["asset", "session_date"], lat())
    merged = parts.groupBy("asset", "bin").agg(F.sum("n").alias("n"))
    return QT.histogram_quantile(merged, ["asset"], 0.95, "p95_s")


@query("agg11_session_admissibility", sql(f"""
SELECT session_date::VARCHAR AS session_date, round(p95,6) AS p95_s, round(b,6) AS backfill_share, round(cut,6) AS cutoff_s, CASE WHEN p95>cut AND b>0.01 THEN 'P95_ABOVE_CUTOFF+BACKFILL_ABOVE_CEILING'
  WHEN p95>cut THEN 'P95_ABOVE_CUTOFF' WHEN b>0.01 THEN 'BACKFILL_ABOVE_CEILING' ELSE 'OK' END AS reason, NOT (p95>cut OR b>0.01) AS admissible, mx<=3*md AS stable
FROM (SELECT *, greatest(60, ceil(2*gp)) AS cut, max(p95) OVER () AS mx, median(p95) OVER () AS md FROM (SELECT session_date, quantile_cont({LAT},0.95) AS p95, avg(({LAT}>60)::INT) AS b FROM tape GROUP BY 1),
 (SELECT quantile_cont({LAT},0.95) AS gp FROM tape))"""))
def _(spark, d):
    t = X.tape(spark, d).withColumn("latency", lat())
    q = QT.group_quantiles(t, ["session_date"], "latency", {"p95_s": 0.95})
    g = QT.group_quantiles(t, [], "latency", {"_g": 0.95}).select(DG.recommended_cutoff(F.col("_g")).alias("cutoff_s"))
    s = t.groupBy("session_date").agg(F.avg((F.col("latency") > 60).cast("double")).alias("backfill_share")).join(q, "session_date")
    v = DG.stability_verdict(s).select("stable")
    return DG.session_admissibility(with_scalars(with_scalars(s, g), v), F.col("cutoff_s"))


ROLE_SQL = "CASE WHEN day(session_date)<=15 THEN 'D' ELSE 'V' END"


def roled(spark, d):
    return X.tape(spark, d).withColumn("role", F.when(F.dayofmonth("session_date") <= 15, "D").otherwise("V"))


@query("agg12_latency_summary", sql(f"""
SELECT coalesce(role,'ALL') AS cohort, coalesce(session_date::VARCHAR,'ALL') AS session, coalesce(asset,'ALL') AS asset, count(*) AS rows, 0::BIGINT AS incomplete, count(*) FILTER (l<0) AS negative,
 round(avg((l<=1)::INT),6) AS share_within_1s, round(avg((l<=60)::INT),6) AS share_within_60s, round(quantile_cont(l,0.5),6) AS p50_s, round(quantile_cont(l,0.95),6) AS p95_s, round(quantile_cont(l,0.99),6) AS p99_s
FROM (SELECT *, {ROLE_SQL} AS role, {LAT} AS l FROM tape) GROUP BY GROUPING SETS ((),(role),(role,session_date),(role,asset))"""))
def _(spark, d):
    return DG.latency_summary(roled(spark, d), [1, 60])


@query("agg13_tape_ledger", sql(f"""
SELECT session_date::VARCHAR AS session_date, count(*) AS rows, count(*) FILTER (l<=0) AS non_positive, count(*) FILTER (l>60) AS over_backfill, count(*)-count(DISTINCT id) AS duplicate_ids,
 count(*) FILTER (created_us//86400000000<>executed_us//86400000000) AS cross_session, min(l) AS min_s, max(l) AS max_s, round(sum(l),6) AS total_s FROM (SELECT *, {LAT} AS l FROM tape) GROUP BY 1"""))
def _(spark, d):
    return DG.latency_ledger(X.tape(spark, d), ["session_date"])


@query("agg14_window_eligibility", sql("""
SELECT o.asset, o.session_date::VARCHAR AS session_date, b.buffer_s, count(*) AS candidates, count(*) FILTER (t.created_us<=o.origin_us-b.buffer_s*1000000) AS eligible,
 count(*) FILTER (t.created_us>o.origin_us-b.buffer_s*1000000) AS delayed, 0::BIGINT AS missing_created FROM origins o, (VALUES (60::BIGINT),(300::BIGINT)) b(buffer_s), tape t
WHERE t.asset=o.asset AND t.executed_us>=o.origin_us-b.buffer_s*1000000-3600000000 AND t.executed_us<o.origin_us-b.buffer_s*1000000 GROUP BY ALL"""))
def _(spark, d):
    return DG.window_eligibility(X.tape(spark, d), X.origins(spark, d), STEP, 2, [60, 300])


@query("agg15_availability_status", sql("""
SELECT asset, status, count(*) AS origins FROM (SELECT asset, CASE WHEN day(session_date)%4<>0 THEN CASE WHEN ok=0 THEN 'USABLE_ZERO' ELSE 'USABLE_ACTIVITY' END
  WHEN ok=0 AND late>0 THEN 'EXCLUDED_DELAYED_TRADES' WHEN ok=0 AND raw=0 THEN 'EXCLUDED_DELAY_CONTEXT_ZERO' WHEN ok=0 THEN 'EXCLUDED_COUNT_MISMATCH' ELSE 'USABLE_ACTIVITY_DELAY_CONTEXT' END AS status
 FROM (SELECT o.origin_id, o.asset, o.session_date, count(t.id) AS raw, count(t.id) FILTER (t.created_us<=o.origin_us-60000000) AS ok, count(t.id) FILTER (t.created_us>o.origin_us-60000000) AS late
  FROM origins o LEFT JOIN tape t ON t.asset=o.asset AND t.executed_us>=o.origin_us-60000000-3600000000 AND t.executed_us<o.origin_us-60000000 GROUP BY ALL)) GROUP BY 1,2"""))
def _(spark, d):
    raw = DG.window_counts(X.tape(spark, d), X.origins(spark, d), STEP, 2, 60)
    z = F.lit(0).cast("bigint")
    st = DG.availability_status(F.col("eligible"), F.dayofmonth("session_date") % 4 == 0, F.col("candidates"), F.col("eligible"), F.col("delayed"), z)
    return raw.select("asset", st.alias("status")).groupBy("asset", "status").agg(F.count(F.lit(1)).alias("origins"))


@query("agg16_incident_audit", sql(f"""
SELECT c.session_date::VARCHAR AS session_date, a.asset, coalesce(n,0)::BIGINT AS rows, first_us, last_us, round(late,6) AS late_share, CASE WHEN n IS NULL THEN 'ABSENT' WHEN late>0.02 THEN 'DELAYED' ELSE 'NORMAL' END AS state
FROM cal c CROSS JOIN assets a LEFT JOIN (SELECT session_date, asset, count(*) n, min(executed_us) first_us, max(executed_us) last_us, avg(({LAT}>60)::INT) late FROM tape GROUP BY 1,2) t ON t.session_date=c.session_date AND t.asset=a.asset"""))
def _(spark, d):
    want = X.calendar(spark, d).select("session_date", F.explode(F.array(*[F.lit(a) for a in X.ASSETS])).alias("asset"))
    return DG.incident_audit(X.tape(spark, d), want)


NREASON_SQL = """nr AS (SELECT n.*, o.minute, CASE WHEN o.minute<480 THEN 'FIRST' WHEN o.minute<960 THEN 'MIDDLE' ELSE 'LAST' END AS tercile, CASE WHEN b0_close IS NULL THEN 'B0_INCOMPLETE' WHEN b1_close IS NULL OR b1_change_30m IS NULL THEN 'B1_INCOMPLETE'
  WHEN b2_trades IS NULL THEN 'B2_INCOMPLETE' ELSE 'NONE' END AS reason FROM nested n JOIN (SELECT origin_id, minute FROM origins) o USING (origin_id))"""


def nested_reasons(spark, d):
    flags, reason = Q.nested_completeness([
        ("b0", F.col("b0_close").isNotNull()), ("b1", F.col("b1_close").isNotNull() & F.col("b1_change_30m").isNotNull()),
        ("b2", F.col("b2_trades").isNotNull())])
    n = nested(spark, d).join(X.origins(spark, d).select("origin_id", "minute"), "origin_id")
    return n.select("*", *flags, reason.alias("reason"), session_tercile(F.col("minute"), 480, 960).alias("tercile"))


@query("agg17_reason_waterfall", sql("""
SELECT asset, tercile, reason, n, origins, round(n/origins::DOUBLE,6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY asset, tercile)::BIGINT AS origins FROM
 (SELECT coalesce(asset,'ALL') AS asset, coalesce(tercile,'ALL') AS tercile, reason, count(*) AS n FROM nr GROUP BY GROUPING SETS ((reason),(asset,reason),(tercile,reason),(asset,tercile,reason))))""",
                                     FEATURES_SQL, NESTED_SQL, NREASON_SQL))
def _(spark, d):
    return DG.reason_waterfall(nested_reasons(spark, d).select("asset", "tercile", "reason"), ["asset", "tercile"], "reason")


ATT_SQL = """att AS (SELECT asset, option_type, CASE WHEN hour(make_timestamp(executed_us))<8 THEN 'FIRST' WHEN hour(make_timestamp(executed_us))<16 THEN 'MIDDLE' ELSE 'LAST' END AS tercile, (id%13*10)::DOUBLE AS age_s, (ask-bid)/((bid+ask)/2.0::DOUBLE) AS rel_spread,
  CASE WHEN id%13*10>60 THEN 'STALE' WHEN bid<=0 OR ask<=bid THEN 'INVALID_SPREAD' WHEN expiry<=session_date THEN 'EXPIRED' ELSE 'NONE' END AS reason, (expiry-session_date)::DOUBLE AS dte FROM tape)"""


def attempts(spark, d):
    t = X.tape(spark, d).withColumn("quote_us", F.col("created_us")).withColumn("cutoff_us", F.col("created_us") + F.col("id") % 13 * 10_000_000)
    m = F.floor(F.pmod("executed_us", F.lit(86_400_000_000)) / 60_000_000)
    width, mid = F.col("ask") - F.col("bid"), (F.col("bid") + F.col("ask")) / 2.0
    spread = F.when(mid != 0, width / mid).otherwise(width * F.lit(float("inf")))  # a mid of zero: infinite, or NaN
    return t.select(
        "asset", "option_type", "quote_us", session_tercile(m, 480, 960).alias("tercile"),
        ((F.col("cutoff_us") - F.col("quote_us")) / 1e6).alias("age_s"), spread.alias("rel_spread"),
        F.coalesce(Q.quote_reason(), F.lit("NONE")).alias("reason"), F.datediff("expiry", "session_date").cast("double").alias("dte"))


@query("agg18_quote_quality", sql("""
SELECT coalesce(asset,'ALL') AS asset, coalesce(tercile,'ALL') AS tercile, count(*) AS attempts, count(*) AS returned, count(*) FILTER (reason='NONE') AS iv_success, round(quantile_cont(age_s,0.5),6) AS median_age_s, round(quantile_cont(age_s,0.95),6) AS p95_age_s,
 round(quantile_cont(rel_spread,0.5),6) AS median_spread, round(quantile_cont(rel_spread,0.95),6) AS p95_spread,
 '{' || concat_ws(',', CASE WHEN count(*) FILTER (reason='EXPIRED')>0 THEN '"EXPIRED":'||count(*) FILTER (reason='EXPIRED') END, CASE WHEN count(*) FILTER (reason='INVALID_SPREAD')>0 THEN '"INVALID_SPREAD":'||count(*) FILTER (reason='INVALID_SPREAD') END,
  CASE WHEN count(*) FILTER (reason='NONE')>0 THEN '"NONE":'||count(*) FILTER (reason='NONE') END, CASE WHEN count(*) FILTER (reason='STALE')>0 THEN '"STALE":'||count(*) FILTER (reason='STALE') END) || '}' AS failures
FROM att GROUP BY CUBE (asset, tercile)""", ATT_SQL))
def _(spark, d):
    return DG.quote_quality(attempts(spark, d), ["asset", "tercile"])


@query("agg18_iv_geometry", sql("""
SELECT asset, option_type, count(*) AS attempts, count(*) FILTER (reason='NONE') AS successes, round(avg((reason='NONE')::INT),6) AS success_rate, round(quantile_cont(dte,0.5),6) AS median_dte, round(quantile_cont(age_s,0.5),6) AS median_age_s FROM att GROUP BY 1,2""", ATT_SQL))
def _(spark, d):
    a = attempts(spark, d)
    k = ["asset", "option_type"]
    ok = F.col("reason") == "NONE"
    return a.groupBy(*k).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), F.avg(ok.cast("double")).alias("success_rate")).join(
        QT.group_quantiles(a, k, "dte", {"median_dte": 0.5}), k).join(QT.group_quantiles(a, k, "age_s", {"median_age_s": 0.5}), k)


@query("agg19_lag_availability", sql("""
SELECT coalesce(asset,'ALL') AS asset, coalesce(tercile,'ALL') AS tercile, count(*) AS origins, count(b1_close) AS b1_close_available, count(b1_change_30m) AS b1_change_30m_available,
 round(count(b1_close)/count(*)::DOUBLE,6) AS b1_close_rate, round(count(b1_change_30m)/count(*)::DOUBLE,6) AS b1_change_30m_rate FROM nr GROUP BY CUBE (asset, tercile)""", FEATURES_SQL, NESTED_SQL, NREASON_SQL))
def _(spark, d):
    return DG.lag_availability(nested_reasons(spark, d), ["asset", "tercile"], ["b1_close", "b1_change_30m"])


@query("agg20_feature_distributions", """
SELECT feature, count(*) AS rows, count(x) AS finite_rows, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS std, round(quantile_cont(x,0.05),6) AS p05, round(quantile_cont(x,0.5),6) AS median, round(quantile_cont(x,0.95),6) AS p95,
 count(*)-count(x) AS missing, false AS near_constant FROM (SELECT unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) AS feature, unnest([l_quantity,l_extendedprice,l_discount,l_tax]) AS x FROM lineitem) GROUP BY 1""")
def _(spark, d):
    return DG.feature_distributions(X.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("agg21_collinearity", """
SELECT count(*) AS complete_rows, unnest(['l_quantity','l_quantity','l_extendedprice']) AS feature_a, unnest(['l_extendedprice','l_discount','l_discount']) AS feature_b,
 unnest([round(abs(corr(l_quantity,l_extendedprice)),6), round(abs(corr(l_quantity,l_discount)),6), round(abs(corr(l_extendedprice,l_discount)),6)]) AS abs_r FROM lineitem""")
def _(spark, d):
    return DG.collinearity(X.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("agg21_rank_and_condition")
def _(spark, d):
    from ..operators import moments as M

    li = X.table(spark, d, "lineitem")
    return M.conditioning(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("agg22_coverage_decision", sql("""
SELECT round(avg(c),6) AS global_coverage, round((SELECT min(v) FROM (SELECT avg(c) v FROM x GROUP BY asset)),6) AS min_asset_coverage, round((SELECT min(v) FROM (SELECT avg(c) v FROM x GROUP BY tercile)),6) AS min_tercile_coverage,
 CASE WHEN avg(c)>=0.3 AND (SELECT min(v) FROM (SELECT avg(c) v FROM x GROUP BY asset))>=0.2 AND (SELECT min(v) FROM (SELECT avg(c) v FROM x GROUP BY tercile))>=0.2 THEN 'PASS' ELSE 'REVISE' END AS status FROM x""",
                                      FEATURES_SQL, NESTED_SQL, NREASON_SQL, "x AS (SELECT asset, tercile, (reason IN ('NONE','B2_INCOMPLETE'))::INT::DOUBLE AS c FROM nr)"))
def _(spark, d):
    return DG.coverage_decision(nested_reasons(spark, d), "b1_complete", ["asset", "tercile"],
                                {"global_coverage": 0.3, "min_asset_coverage": 0.2, "min_tercile_coverage": 0.2})


LONG_SQL = """long AS (SELECT origin_id, asset, session_date, 'base' AS model, actual, f_base AS forecast FROM panel UNION ALL SELECT origin_id, asset, session_date, 'wide', actual, f_wide FROM panel),
 lossl AS (SELECT *, actual/forecast-ln(actual/forecast)-1 AS loss, CASE WHEN session_date<DATE '1999-01-01' THEN 'first' ELSE 'second' END AS block FROM long)"""


def long_losses(spark, d):
    p = X.orders_series(spark, d)
    pair = F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("f_base").alias("forecast")),
                             F.struct(F.lit("wide").alias("model"), F.col("f_wide").alias("forecast"))))
    out = p.select("origin_id", "asset", "session_date", "actual", "account", pair.alias("_m")).select("*", "_m.*").drop("_m")
    return out.withColumn("loss", qlike(F.col("actual"), F.col("forecast"))).withColumn(
        "block", F.when(F.col("session_date") < F.lit("1999-01-01").cast("date"), "first").otherwise("second"))


@query("agg23_forecast_metrics", sql("""
SELECT block, model, count(*) AS n, round(avg(loss),6) AS qlike, round(avg(abs(forecast-actual)),6) AS mae, round(sqrt(avg(pow(forecast-actual,2))),6) AS rmse FROM lossl GROUP BY 1,2""", LONG_SQL))
def _(spark, d):
    return EV.forecast_metrics(long_losses(spark, d), ["block", "model"], "actual", "forecast")


@query("agg24_session_differences", sql("""
SELECT asset, session_date::VARCHAR AS session_date, round(avg(d),6) AS value, count(*) AS origins FROM (SELECT asset, session_date, actual/f_base-ln(actual/f_base)-(actual/f_wide-ln(actual/f_wide)) AS d FROM panel) GROUP BY 1,2"""))
def _(spark, d):
    p = X.orders_series(spark, d)
    diff = qlike(F.col("actual"), F.col("f_base")) - qlike(F.col("actual"), F.col("f_wide"))
    return EV.session_differences(p.withColumn("d", diff), ["asset"], "d")


@query("agg25_slice_summary", sql("""
SELECT slice, grp AS "group", n, round(mean,6) AS mean, round(overall,6) AS overall, round(leave_out,6) AS leave_out, groups, round(dominance,6) AS dominance, sum((mean>0)::INT) OVER (PARTITION BY slice)::BIGINT AS positive_groups,
 sum((sign(leave_out)<>sign(overall))::INT) OVER (PARTITION BY slice)::BIGINT AS flips FROM (SELECT *, s/n AS mean, sum(s) OVER w/sum(n) OVER w AS overall, (sum(s) OVER w-s)/(sum(n) OVER w-n) AS leave_out, count(*) OVER w AS groups, max(abs(s)) OVER w/sum(abs(s)) OVER w AS dominance
 FROM (SELECT slice, grp, sum(d) s, count(d) n FROM (SELECT unnest(['asset','month','tail']) AS slice, unnest([asset, month(session_date)::VARCHAR, (account%10)::VARCHAR]) AS grp, actual/f_base-ln(actual/f_base)-(actual/f_wide-ln(actual/f_wide)) AS d FROM panel) GROUP BY 1,2)
 WINDOW w AS (PARTITION BY slice))"""))
def _(spark, d):
    p = X.orders_series(spark, d)
    diff = qlike(F.col("actual"), F.col("f_base")) - qlike(F.col("actual"), F.col("f_wide"))
    return EV.slice_summary(p.withColumn("d", diff), "d", {
        "asset": F.col("asset"), "month": F.month("session_date"), "tail": F.col("account") % 10})


@query("agg26_tail_auc", sql("""
SELECT asset, sum(l)::BIGINT AS positives, count(*)-sum(l)::BIGINT AS negatives, round((sum(rk) FILTER (l=1)-sum(l)*(sum(l)+1)/2.0::DOUBLE)/(sum(l)*(count(*)-sum(l))),6) AS auc FROM (
 SELECT p.asset, (actual>th)::INT AS l, rank() OVER (PARTITION BY p.asset ORDER BY f_base) + (count(*) OVER (PARTITION BY p.asset, f_base)-1)/2.0::DOUBLE AS rk FROM panel p
 JOIN (SELECT asset, quantile_cont(actual,0.9) th FROM panel WHERE session_date<DATE '1999-01-01' GROUP BY 1) t USING (asset)) GROUP BY 1"""))
def _(spark, d):
    p = X.orders_series(spark, d).withColumn("is_train", F.col("session_date") < F.lit("1999-01-01").cast("date"))
    return RK.auc(RK.tail_labels(p, ["asset"], "actual", "is_train", 0.9), ["asset"], "tail", "f_base")


@query("agg27_rank_correlations", sql("""
SELECT asset, round(corr(rx,ry),6) AS spearman FROM (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY f_base)+(count(*) OVER (PARTITION BY asset, f_base)-1)/2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY asset ORDER BY actual)+(count(*) OVER (PARTITION BY asset, actual)-1)/2.0::DOUBLE AS ry FROM panel) GROUP BY 1"""))
def _(spark, d):
    return RK.spearman(X.orders_series(spark, d), ["asset"], "f_base", "actual")


@query("agg27_kendall_tau")
def _(spark, d):
    return RK.kendall(X.orders_series(spark, d), ["asset"], "f_base", "actual", "origin_id")


@query("agg27_decile_spread", sql("""
SELECT asset, b AS bucket, round(avg(actual),6) AS mean, count(*) AS rows FROM (SELECT *, ntile(10) OVER (PARTITION BY asset ORDER BY f_base, origin_id) AS b FROM panel) GROUP BY 1,2"""))
def _(spark, d):
    return RK.deciles(X.orders_series(spark, d), ["asset"], "f_base", "origin_id", "actual")


@query("agg28_seasonality_index", sql("""
SELECT origin_id, round(coalesce(s,0),6) AS seasonality FROM panel p LEFT JOIN (SELECT month(session_date) AS m, avg(ln(actual))-(SELECT avg(ln(actual)) FROM panel WHERE session_date<DATE '1996-06-01') AS s
 FROM panel WHERE session_date<DATE '1996-06-01' GROUP BY 1) x ON x.m=month(p.session_date)"""))
def _(spark, d):
    p = X.orders_series(spark, d).select("origin_id", F.month("session_date").alias("bucket"), F.log("actual").alias("y"),
                                         (F.col("session_date") < F.lit("1996-06-01").cast("date")).alias("is_train"))
    return EV.seasonality_index(p, "bucket", "y", "is_train").select("origin_id", "seasonality")


@query("agg29_trade_tensor", sql(f"""
SELECT o.origin_id, cell, round(sum(vega*size*100*d),3) AS vega_flow, round(sum(premium*d),4) AS signed_premium FROM origins o JOIN (SELECT *, CASE tags WHEN 'ask_side' THEN 1 WHEN 'bid_side' THEN -1 ELSE 0 END AS d,
  ((lm>-0.1)::INT+(lm>-0.05)::INT+(lm>-0.01)::INT+(lm>0.01)::INT+(lm>0.05)::INT+(lm>0.1)::INT)*8 + ((dte>7)::INT+(dte>14)::INT+(dte>21)::INT)*2+(option_type='call')::INT::BIGINT AS cell FROM
  (SELECT *, greatest(expiry-session_date,1) AS dte FROM chd)) t ON t.asset=o.asset AND t.created_us<=o.origin_us-120000000 AND t.created_us>=o.origin_us-120000000-7200000000 GROUP BY 1,2""",
                                 MARK_SQL, """chd AS (SELECT *, ln(strike/mark) AS lm, mark*exp(-0.5*d1*d1)/sqrt(2*pi())*sqrt(ten) AS vega FROM (SELECT *, (ln(mark/strike)+0.5*sig*sig*ten)/(sig*sqrt(ten)) AS d1 FROM
   (SELECT *, greatest(expiry-session_date,1)/365.0::DOUBLE AS ten, greatest(least(iv,5),0.01) AS sig FROM mtape)))"""))
def _(spark, d):
    t = SF.trade_tensor(PN.chain_tape(spark, d), X.origins(spark, d), STEP, 4, 120, (-0.1, -0.05, -0.01, 0.01, 0.05, 0.1), (7, 14, 21))
    return t.select("origin_id", "cell", F.round("vega_flow", 3).alias("vega_flow"), F.round("signed_premium", 4).alias("signed_premium"))


@query("agg30_loss_pivot", sql("""
SELECT session_date::VARCHAR AS session_date, round(avg(loss) FILTER (model='base'),6) AS base, round(avg(loss) FILTER (model='wide'),6) AS wide FROM lossl GROUP BY 1""", LONG_SQL))
def _(spark, d):
    return EV.pivot_losses(long_losses(spark, d), ["base", "wide"])


@query("agg31_regime_summary", sql("""
SELECT asset, min(session_date)::VARCHAR AS first, max(session_date)::VARCHAR AS last, count(*) AS sessions, round(quantile_cont(i,0.5),6) AS index_median, round(quantile_cont(i,0.9),6) AS index_p90, round(max(i),6) AS index_max, round(avg(t),6) AS mean_daily_target
FROM (SELECT asset, session_date, avg(f_base) i, avg(actual) t FROM panel WHERE NOT session_date BETWEEN DATE '1997-03-03' AND DATE '1997-03-07' GROUP BY 1,2) GROUP BY 1"""))
def _(spark, d):
    kept = EV.leave_ranges_out(X.orders_series(spark, d), [("1997-03-03", "1997-03-07")])
    return EV.regime_summary(kept, ["asset"], "session_date", "f_base", "actual")


@query("agg32_annualised_errors", sql("""
SELECT model, round(sqrt(avg(pow(e,2)))*100,4) AS vol_rmse_points, round(avg(abs(e))*100,4) AS vol_mae_points, round(avg(abs(forecast-actual)),6) AS cost_per_window FROM (SELECT *, sqrt(forecast*252*13)-sqrt(actual*252*13) AS e FROM long) GROUP BY 1""", LONG_SQL))
def _(spark, d):
    e = EV.annualised_errors(long_losses(spark, d), ["model"], "actual", "forecast")
    return e.withColumns({c: F.round(c, 4) for c in ("vol_rmse_points", "vol_mae_points")})


@query("agg33_scorecard", sql(f"""
SELECT 'tape' AS section, unnest(['rows','late_share']) AS field, unnest([count(*)::DOUBLE, round(avg(({LAT}>60)::INT),6)]) AS value FROM tape
UNION ALL SELECT 'panel', unnest(['origins','b0_coverage','duplicate_keys']), unnest([count(*)::DOUBLE, round(count(b0_close)/count(*)::DOUBLE,6), (count(*)-count(DISTINCT origin_id))::DOUBLE]) FROM feat
UNION ALL SELECT 'losses', unnest(['mean_base','mean_wide']), unnest([round(avg(loss) FILTER (model='base'),6), round(avg(loss) FILTER (model='wide'),6)]) FROM lossl""", FEATURES_SQL, LONG_SQL))
def _(spark, d):
    t = X.tape(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.avg((lat() > 60).cast("double")).alias("late_share"))
    f = features(spark, d).groupBy("origin_id").agg(F.count(F.lit(1)).alias("n"), F.count("b0_close").alias("c")).agg(
        F.sum("n").alias("origins"), (F.sum("c") / F.sum("n")).alias("b0_coverage"), F.sum(F.col("n") - 1).alias("duplicate_keys"))
    ls = long_losses(spark, d).agg(F.avg(F.when(F.col("model") == "base", F.col("loss"))).alias("mean_base"),
                                   F.avg(F.when(F.col("model") == "wide", F.col("loss"))).alias("mean_wide"))
    return DG.scorecard({"tape": t, "panel": f, "losses": ls})


@query("agg35_role_summary", sql(f"""
SELECT {ROLE_SQL} AS role, count(DISTINCT session_date) AS sessions, min(session_date)::VARCHAR AS first, max(session_date)::VARCHAR AS last, string_agg(DISTINCT asset, ',' ORDER BY asset) AS assets,
 count(DISTINCT (session_date, asset)) AS files, count(*) AS rows FROM tape GROUP BY 1"""))
def _(spark, d):
    scan = X.table(spark, d, "events").select("*", "_metadata", F.to_date("ts").alias("session_date"), F.col("event_type").alias("asset"))
    role = F.when(F.dayofmonth("session_date") <= 15, "D").otherwise("V")
    return DG.role_summary(partition_inventory(scan, ["session_date", "asset"], role))


@query("agg36_metric_drift", sql("""
SELECT model, round(max(q) FILTER (block='second')-max(q) FILTER (block='first'),6) AS qlike_drift, round(max(m) FILTER (block='second')-max(m) FILTER (block='first'),6) AS mae_drift FROM
 (SELECT block, model, avg(loss) q, avg(abs(forecast-actual)) m FROM lossl GROUP BY 1,2) GROUP BY 1""", LONG_SQL))
def _(spark, d):
    m = EV.forecast_metrics(long_losses(spark, d), ["block", "model"], "actual", "forecast")
    return EV.metric_drift(m, ["model"], "block", ("first", "second"), ["qlike", "mae"])


@query("agg37_parity_feasibility", sql("""
SELECT asset, count(*) AS origins, count(*) FILTER (pairs>0) AS with_pairs, count(*) FILTER (two>0) AS with_two_strikes, round(quantile_cont(pairs::DOUBLE,0.5),6) AS median_pairs FROM
 (SELECT a.asset, a.session_date, coalesce(sum(n),0) AS pairs, count(*) FILTER (n>=2) AS two FROM (SELECT DISTINCT asset, session_date FROM tape) a LEFT JOIN (SELECT asset, session_date, expiry, count(*) n FROM pairs GROUP BY 1,2,3) p
  ON p.asset=a.asset AND p.session_date=a.session_date GROUP BY 1,2) GROUP BY 1""", PAIRS_SQL))
def _(spark, d):
    base = X.tape(spark, d).select("asset", "session_date").distinct()
    return SF.parity_feasibility(base, pairs(spark, d), ["asset"], ["asset", "session_date"])


@query("agg38_source_coverage", sql("""
SELECT asset, session_date::VARCHAR AS session_date, count(*) AS rows, count(*) FILTER (size>50) AS with_evidence, '{'||string_agg('"'||tags||'":'||n, ',' ORDER BY tags)||'}' AS reasons FROM
 (SELECT asset, session_date, tags, size, 0 AS n FROM tape) GROUP BY 1,2""".replace("count(*) AS rows, count(*) FILTER (size>50) AS with_evidence", "sum(n)::BIGINT AS rows, sum(e)::BIGINT AS with_evidence").replace(
     "(SELECT asset, session_date, tags, size, 0 AS n FROM tape)", "(SELECT asset, session_date, tags, count(*) n, count(*) FILTER (size>50) e FROM tape GROUP BY 1,2,3)")))
def _(spark, d):
    t = X.tape(spark, d).withColumn("evidence", F.when(F.col("size") > 50, F.col("id")))
    return DG.source_coverage(t, ["asset", "session_date"], "tags", "evidence")


@query("agg39_timing_audit", sql("""
SELECT coalesce(cutoff_s::VARCHAR,'ALL') AS cutoff_s, coalesce(asset,'ALL') AS asset, count(*) AS requests, count(q) AS selected, 0::BIGINT AS future, count(*) FILTER (ask>bid) AS usable, round(quantile_cont(age,0.5),6) AS median_age_s, count(*)-count(q) AS none_found FROM
 (SELECT o.asset, o.cutoff_s, q.created_us AS q, q.bid, q.ask, (o.at-q.created_us)/1e6::DOUBLE AS age FROM (SELECT asset, cutoff_s, origin_us-cutoff_s*1000000 AS at FROM origins, (VALUES (0::BIGINT),(60::BIGINT),(300::BIGINT)) c(cutoff_s)) o
  ASOF LEFT JOIN (SELECT asset, created_us, arg_max(bid,id) AS bid, arg_max(ask,id) AS ask FROM tape GROUP BY 1,2) q ON q.asset=o.asset AND o.at>=q.created_us) GROUP BY CUBE (cutoff_s, asset)"""))
def _(spark, d):
    cut = F.explode(F.array(*[F.lit(c).cast("bigint") for c in (0, 60, 300)]))
    o = X.origins(spark, d).withColumn("cutoff_s", cut).withColumn("origin_us", F.col("origin_us") - F.col("cutoff_s") * 1_000_000)
    q = X.tape(spark, d).select("asset", F.col("created_us").alias("quote_us"), "id", "bid", "ask")
    s = J.last_quote(o, q, ["asset"], 0, ["bid", "ask"])
    s = s.select("asset", F.col("cutoff_s").cast("string").alias("cutoff_s"), ((F.col("cutoff_us") - F.col("quote_us")) / 1e6).alias("quote_age_s"),
                 (F.col("ask") > F.col("bid")).alias("usable"))
    return DG.timing_audit(s, ["cutoff_s", "asset"])


@query("agg40_coding_traceability", sql("""
SELECT asset, session_date::VARCHAR AS session_date, count(*) AS expected, count(*) FILTER (b0_close IS NOT NULL) AS coded, count(*) FILTER (b0_close IS NOT NULL AND v IS NULL) AS null_coded, count(*) FILTER (b0_close IS NOT NULL AND v=0) AS zero_coded,
 count(*) FILTER (b0_close IS NOT NULL AND v>0) AS nonzero_coded, count(*) FILTER (b0_close IS NULL)=0 AS complete FROM (SELECT *, CASE WHEN minute%90<>0 THEN coalesce(b2_trades,0) END AS v FROM feat) GROUP BY 1,2""", FEATURES_SQL))
def _(spark, d):
    f = features(spark, d).withColumn("v", F.when(F.col("minute") % 90 != 0, F.coalesce("b2_trades", F.lit(0).cast("bigint"))))
    return DG.coding_traceability(f, f.where(F.col("b0_close").isNotNull()), ["asset", "session_date"], "v")


def _act_all(delay):
    return f"""SELECT o.origin_id, {delay}::BIGINT AS delay_s, count(e.id) AS trades, count(DISTINCT e.contract) AS contracts, round(coalesce(sum(e.premium),0),4) AS total_premium FROM origins o LEFT JOIN
 (SELECT o.origin_id AS oid, t.* FROM origins o JOIN tape t ON t.asset=o.asset AND t.executed_us>=o.origin_us-{delay}000000-7200000000 AND t.executed_us<o.origin_us-{delay}000000 AND t.created_us<=o.origin_us-{delay}000000) e ON e.oid=o.origin_id GROUP BY 1"""


@query("agg41_activity_three_cutoffs", sql(" UNION ALL ".join(_act_all(x) for x in (60, 120, 300))))
def _(spark, d):
    return activity(spark, d, [60, 120, 300]).select("origin_id", "delay_s", "trades", "contracts", F.round("total_premium", 4).alias("total_premium"))

