"""Queries over time expressions, keys and origin grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import time as T
from ..operators import features as FE
from ..operators import grid as G
from . import standin as X
from .registry import query
from .standin import sql

STAMPS = """stamps AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(600+o_orderkey%600 AS INTEGER))
    + to_seconds(CAST(CASE WHEN o_orderkey%10=0 THEN 0 ELSE o_orderkey%60 END AS INTEGER)) AS w FROM orders)"""


def stamps(spark, d):
    k = F.col("o_orderkey")
    sec = (600 + k % 600) * 60 + F.when(k % 10 == 0, 0).otherwise(k % 60)
    us = C.date_micros(F.to_date("o_orderdate")) + sec * 1_000_000
    return X.table(spark, d, "orders").select(k.alias("id"), us.alias("us"))


@query("prj1_parse_wall_time", sql("""
SELECT id, epoch_us(timezone('UTC', timezone('America/New_York', w))) AS us FROM stamps""", STAMPS))
def _(spark, d):
    s = stamps(spark, d)
    text = F.date_format(T.ntz_from_micros(F.col("us")), "yyyy-MM-dd HH:mm:ss")
    return s.select("id", T.parse_wall(text, "yyyy-MM-dd HH:mm:ss", T.NEW_YORK).alias("us"))


@query("prj2_new_york_wall", sql("""
SELECT id, epoch_us(timezone('America/New_York', timezone('UTC', w))) AS wall_us,
  epoch_us(w) AS back_us FROM stamps""", STAMPS))
def _(spark, d):
    wall = T.to_wall(F.col("us"))
    return stamps(spark, d).select("id", C.ntz_micros(wall).alias("wall_us"), T.to_utc(wall).alias("back_us"))


NY = "timezone('America/New_York', timezone('UTC', w))"


@query("prj3_regular_session", sql(f"""
SELECT id, ({NY}::DATE)::VARCHAR AS session_date,
  dayofweek({NY}) BETWEEN 1 AND 5 AND hour({NY})*60+minute({NY}) >= 570
  AND hour({NY})*60+minute({NY}) < 960 AS regular FROM stamps""", STAMPS))
def _(spark, d):
    us = F.col("us")
    return stamps(spark, d).select("id", T.session_date(us).alias("session_date"),
                                   T.is_regular_minute(us).alias("regular"))


@query("prj4_aligned_origin", sql(f"""
SELECT id, CASE WHEN dayofweek({NY}) BETWEEN 1 AND 5 AND hour({NY})*60+minute({NY}) >= 570
  AND hour({NY})*60+minute({NY}) < 960 AND epoch_us(w)%300000000=0 THEN epoch_us(w) END AS origin_us
FROM stamps""", STAMPS))
def _(spark, d):
    return stamps(spark, d).select("id", T.aligned_origin(F.col("us")).alias("origin_us"))


@query("prj5_session_calendar", sql("""
SELECT session_date::VARCHAR AS session_date, minutes, open_us, open_us+minutes*60000000 AS close_us,
  minutes=720 AS is_early FROM cal"""))
def _(spark, d):
    return X.calendar(spark, d)


@query("prj6_origin_grid", sql("""
SELECT asset, session_date::VARCHAR AS session_date, minute, open_us+minute*60000000 AS origin_us,
  asset||':'||(open_us+minute*60000000)::VARCHAR AS origin_id
FROM (SELECT session_date, open_us, unnest(generate_series(5, minutes-30, 5)) AS minute FROM cal WHERE minutes>0), assets"""))
def _(spark, d):
    return G.origin_grid(X.calendar(spark, d), X.ASSETS, 5, 30, 5)


@query("prj7_session_sized_grid", sql("""
SELECT asset, session_date::VARCHAR AS session_date, minute FROM
 (SELECT session_date, unnest(generate_series(30, minutes-31, 5)) AS minute FROM cal WHERE minutes>0)
 JOIN (SELECT asset, session_date, min(bar)*30 AS first_minute FROM bars GROUP BY 1,2) USING (session_date)
WHERE minute >= first_minute + 30"""))
def _(spark, d):
    return FE.sized_origins(X.calendar(spark, d), X.bars(spark, d), X.ASSETS, 30, 5, 30, X.BAR_MINUTES)


@query("prj8_event_presence", sql("""
SELECT o.origin_id, coalesce(bool_or(t.id IS NOT NULL), false) AS event_present FROM origins o
LEFT JOIN tape t ON t.asset=o.asset AND t.executed_us > o.origin_us-3600000000 AND t.executed_us <= o.origin_us
GROUP BY 1"""))
def _(spark, d):
    return FE.event_presence(X.origins(spark, d), X.tape(spark, d), X.SLOT_US, 2)


@query("prj9_contract_key", sql("SELECT id, contract FROM tape"))
def _(spark, d):
    return X.tape(spark, d).select("id", "contract")


ML = """ml AS (SELECT *, greatest(0, least(size, coalesce(multi_vol - lag(multi_vol) OVER
  (PARTITION BY asset, contract ORDER BY created_us, id), 0))) AS multileg_size FROM tape)"""


@query("prj10_direction_and_flags", sql("""
SELECT id, CASE WHEN multileg_size>0 THEN 0.0 WHEN tags='ask_side' THEN 1.0 WHEN tags='bid_side' THEN -1.0
  ELSE 0.0 END::DOUBLE AS direction, flags LIKE '%sweep%' AS is_sweep FROM ml""", ML))
def _(spark, d):
    t = FE.multileg_size(X.tape(spark, d))
    return t.select("id", C.trade_direction(F.col("tags"), F.col("multileg_size") > 0).alias("direction"),
                    F.col("flags").contains("sweep").alias("is_sweep"))


@query("prj11_two_clocks", sql("""
SELECT asset, session_date::VARCHAR AS session_date, count(*) AS rows,
  round(avg((created_us-executed_us)/1e6::DOUBLE),6) AS mean_latency_s,
  count(*) FILTER ((created_us-executed_us)/1e6 > 60) AS late_rows FROM tape GROUP BY ALL"""))
def _(spark, d):
    lat = C.latency_seconds(F.col("created_us"), F.col("executed_us"))
    return X.tape(spark, d).groupBy("asset", "session_date").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(lat).alias("mean_latency_s"),
        F.count_if(lat > 60).alias("late_rows"))


@query("prj12_expiry_tenor", sql("""
SELECT t.id, round((coalesce(c.open_us+c.minutes*60000000, epoch_us(t.expiry::TIMESTAMP)+57600000000)
   - t.executed_us)/1e6::DOUBLE/(365.25::DOUBLE*86400),6) AS exact_years,
  round(greatest((epoch_us(t.expiry::TIMESTAMP)+57600000000 - t.executed_us)/1e6::DOUBLE, 0.0)/(365.0::DOUBLE*86400),6) AS floored_years
FROM tape t LEFT JOIN cal c ON c.session_date=t.expiry AND c.minutes>0"""))
def _(spark, d):
    t = T.expiry_close(X.tape(spark, d), X.calendar(spark, d), "expiry", 960)
    plain_close = C.date_micros("expiry") + F.lit(960 * 60_000_000)
    e = F.col("executed_us")
    return t.select("id", T.tenor_years(F.col("expiry_close_us"), e).alias("exact_years"),
                    T.tenor_years(plain_close, e, T.YEAR_SECONDS_365, True).alias("floored_years"))


@query("prj13_window_bounds", sql("""
SELECT id, ((executed_us+60000000)//300000000+1)*300000000 AS origin_us,
  ((executed_us+60000000)//300000000+1)*300000000-360000000 AS start_us,
  ((executed_us+60000000)//300000000+1)*300000000-60000000 AS end_us FROM tape"""))
def _(spark, d):
    o = T.strict_window_origin(F.col("executed_us"), 60)
    a, b = T.window_bounds(o, 60)
    return X.tape(spark, d).select("id", o.alias("origin_us"), a.alias("start_us"), b.alias("end_us"))


@query("prj14_bands_and_terciles", sql("""
SELECT origin_id, minute//30 AS band, CASE WHEN minute<130 THEN 'FIRST' WHEN minute<260 THEN 'MIDDLE' ELSE 'LAST' END AS tercile,
  CASE WHEN minute<=130 THEN 'FIRST' WHEN minute<=260 THEN 'MIDDLE' ELSE 'LAST' END AS tercile_closed,
  asset||'|60m:'||(minute//60)::VARCHAR AS key60 FROM origins"""))
def _(spark, d):
    m = F.col("minute")
    return X.origins(spark, d).select(
        "origin_id", T.band_id(m).alias("band"), T.session_tercile(m).alias("tercile"),
        T.session_tercile(m, closed=True).alias("tercile_closed"),
        T.band_key(F.col("asset"), m, "60").alias("key60"))


@query("prj15_transforms", """
SELECT c_custkey AS id, round(ln(greatest(c_acctbal, 1e-12::DOUBLE)),6) AS log_x,
  round(sign(c_acctbal)*ln(1+abs(c_acctbal)),6) AS signed_x, c_acctbal AS raw_x FROM customer""")
def _(spark, d):
    return X.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), C.transform("c_acctbal", "log").alias("log_x"),
        C.transform("c_acctbal", "signed_log").alias("signed_x"), C.transform("c_acctbal", "raw").alias("raw_x"))


@query("prj17_harmonics_and_slices", sql("""
SELECT origin_id, round(sin(2*pi()*minute/1440),6) AS sin_minute, round(cos(2*pi()*minute/1440),6) AS cos_minute,
  session_date BETWEEN tf-4 AND tf AS expiration_week,
  CASE WHEN minute<60 THEN 'open' WHEN minute>=minutes-60 THEN 'close' ELSE 'midday' END AS day_part
FROM origins JOIN cal USING (session_date), LATERAL (SELECT date_trunc('month', session_date)::DATE
  + CAST((5-dayofweek(date_trunc('month', session_date))+7)%7+14 AS INTEGER) AS tf)"""))
def _(spark, d):
    s, c = T.harmonics(F.col("minute"), 1440.0)
    o = X.origins(spark, d).join(X.calendar(spark, d).select("session_date", "minutes"), "session_date")
    return o.select("origin_id", s.alias("sin_minute"), c.alias("cos_minute"),
                    T.is_expiration_week(F.col("session_date")).alias("expiration_week"),
                    T.day_part(F.col("minute"), F.col("minutes")).alias("day_part"))


@query("prj18_volatility_strata", sql("""
SELECT origin_id, CASE WHEN f_base<=lo THEN 'LOW' WHEN f_base<=hi THEN 'MIDDLE' ELSE 'HIGH' END AS regime
FROM panel, (SELECT quantile_cont(f_base, 1.0::DOUBLE/3) lo, quantile_cont(f_base, 2.0::DOUBLE/3) hi FROM panel
  WHERE session_date < DATE '1999-01-01')"""))
def _(spark, d):
    p = X.orders_series(spark, d)
    cuts = FE.training_cutpoints(p, "f_base", F.col("session_date") < F.lit("1999-01-01").cast("date"))
    return FE.regime(p, cuts, "f_base").select("origin_id", "regime")


@query("prj19_alias_canonical", """
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey%2=0 THEN c_acctbal END, c_acctbal) AS balance,
  0::BIGINT AS conflicts FROM customer""")
def _(spark, d):
    c = X.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_acctbal").alias("acct_balance"))
    return FE.canonicalise(c, {"acct_balance": "balance"})


@query("prj20_timing_variant", sql("""
SELECT origin_id, round(f_wide,6) AS forecast, round(actual,6) AS actual FROM panel"""))
def _(spark, d):
    p = X.orders_series(spark, d).withColumnsRenamed({"f_base": "forecast", "f_wide": "forecast_120s"})
    return FE.swap_variant(p, ["forecast"], "120s").select("origin_id", "forecast", "actual")
