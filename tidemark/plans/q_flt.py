"""Queries over filters and data-quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import date_micros, floor_div
from ..operators import quality as Q
from . import standin as X
from .registry import query
from .standin import sql

FOLDS = [(1, "2024-01-10", "2024-01-11", "2024-01-17"), (2, "2024-01-17", "2024-01-18", "2024-01-24"),
         (3, "2024-01-24", "2024-01-25", "2024-01-30")]
FOLD_SQL = """folds AS (SELECT * FROM (VALUES (1::BIGINT, DATE '2024-01-10', DATE '2024-01-11', DATE '2024-01-17'),
  (2, DATE '2024-01-17', DATE '2024-01-18', DATE '2024-01-24'),
  (3, DATE '2024-01-24', DATE '2024-01-25', DATE '2024-01-30')) f(fold, train_end, test_start, test_end))"""

FEATURES_SQL = """feat AS (
  SELECT o.*, b.close AS b0_close, p.close AS b1_close, t.n AS b2_trades, n.close AS target
  FROM origins o
  LEFT JOIN bars b ON b.asset=o.asset AND b.session_date=o.session_date AND b.bar=o.minute//30-1
  LEFT JOIN bars p ON p.asset=o.asset AND p.session_date=o.session_date AND p.bar=o.minute//30-2
  LEFT JOIN bars n ON n.asset=o.asset AND n.session_date=o.session_date AND n.bar=o.minute//30
  LEFT JOIN (SELECT asset, (executed_us//1800000000+1)*1800000000 AS origin_us, count(*) n FROM tape GROUP BY 1,2) t
    ON t.asset=o.asset AND t.origin_us=o.origin_us)"""


def features(spark, d):
    """Origins with the last two closes, the trade count and the next close as target."""
    b = X.bars(spark, d).select("asset", "session_date", "bar", "close")
    keys = ["asset", "session_date", "minute"]
    out = X.origins(spark, d)
    for name, lag in (("b0_close", 1), ("b1_close", 2), ("target", 0)):
        out = out.join(
            b.select("asset", "session_date", ((F.col("bar") + lag) * 30).alias("minute"),
                     F.col("close").alias(name)), keys, "left")
    n = X.tape(spark, d).groupBy(
        "asset", ((floor_div(F.col("executed_us"), X.SLOT_US) + 1) * X.SLOT_US).alias("origin_us")
    ).agg(F.count(F.lit(1)).alias("b2_trades"))
    return out.join(n, ["asset", "origin_us"], "left")


@query("flt1_quote_reason", sql("""
SELECT coalesce(reason,'OK') AS reason, asset, count(*) AS n FROM (SELECT asset, CASE
  WHEN id%13*10 > 60 THEN 'STALE' WHEN bid<=0 OR ask<=bid THEN 'INVALID_SPREAD'
  WHEN (ask-bid)/((bid+ask)/2.0::DOUBLE) > 0.25 THEN 'WIDE_SPREAD' WHEN iv<=0 THEN 'IV_INVALID'
  WHEN expiry<=session_date THEN 'EXPIRED' END AS reason FROM tape) GROUP BY 1,2"""))
def _(spark, d):
    t = X.tape(spark, d).withColumn("quote_us", F.col("created_us")).withColumn(
        "cutoff_us", F.col("created_us") + F.col("id") % 13 * 10_000_000)
    return t.select("asset", F.coalesce(Q.quote_reason(), F.lit("OK")).alias("reason")).groupBy(
        "reason", "asset").agg(F.count(F.lit(1)).alias("n"))


@query("flt2_availability", sql("""
SELECT id, executed_us >= o-1800000000-60000000 AND executed_us < o-60000000
  AND greatest(executed_us, created_us) <= o-60000000 AS eligible, created_us+60000000<=o AS bar_ok
FROM (SELECT *, ((executed_us+60000000)//1800000000+1)*1800000000 AS o FROM tape)"""))
def _(spark, d):
    o = (floor_div(F.col("executed_us") + 60_000_000, X.SLOT_US) + 1) * X.SLOT_US
    end = o - 60_000_000
    return X.tape(spark, d).select(
        "id", Q.is_available(F.col("executed_us"), F.col("created_us"), end - X.SLOT_US, end).alias("eligible"),
        Q.bar_available(F.col("created_us"), o, 60).alias("bar_ok"))


@query("flt3_in_session", sql("""
SELECT t.id, m.mark FROM (SELECT *, (executed_us%86400000000)//1800000000 AS bar FROM tape) t JOIN
 (SELECT asset, session_date, bar, CASE WHEN bar=0 THEN open ELSE lag(close) OVER
   (PARTITION BY asset, session_date ORDER BY bar) END AS mark FROM grid) m USING (asset, session_date, bar)
WHERE m.mark > 0"""))
def _(spark, d):
    from . import panels
    return panels.marked_tape(spark, d).select("id", "mark")


@query("flt4_target_blind_strip", sql("SELECT origin_id, asset, b0_close FROM feat", FEATURES_SQL))
def _(spark, d):
    f = Q.strip_columns(features(spark, d)).select("origin_id", "asset", "b0_close")
    Q.forbid_columns(f)
    return f


@query("flt5_key_violations", sql("""
SELECT asset, contract, session_date::VARCHAR AS session_date, count(*) AS copies FROM tape GROUP BY ALL HAVING count(*)>1"""))
def _(spark, d):
    return Q.key_violations(X.tape(spark, d), ["asset", "contract", "session_date"])


@query("flt6_join_cardinality", """
SELECT (SELECT count(*) FROM customer) AS left_rows, count(*) AS joined_rows,
  (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*)>1)) AS right_duplicates,
  false AS one_to_one FROM customer LEFT JOIN orders ON o_custkey=c_custkey""")
def _(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = X.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return Q.join_cardinality(c, o, ["k"])


@query("flt7_schema_fingerprint", """
SELECT sha256('event_id:bigint|event_type:string|props:string|ts:timestamp_ntz|user_id:bigint|value:double') AS fingerprint,
  count(*) AS rows FROM events""")
def _(spark, d):
    e = Q.require_columns(X.table(spark, d, "events"), ["event_id", "ts"])
    return e.agg(F.count(F.lit(1)).alias("rows")).select(Q.schema_fingerprint(e).alias("fingerprint"), "rows")


@query("flt8_row_quality", sql("""
SELECT asset, count(*) AS rows, count(*)-count(DISTINCT (session_date, bar)) AS duplicate_keys, 0::BIGINT AS critical_nulls,
  count(*) FILTER (NOT (open>0 AND high>0 AND low>0 AND close>0 AND low<=least(open,close) AND high>=greatest(open,close))) AS invalid_ohlc,
  round(least(count(*)/1344.0::DOUBLE,1.0),6) AS completeness FROM bars GROUP BY 1"""))
def _(spark, d):
    return Q.row_quality(X.bars(spark, d), ["asset"], ["asset", "session_date", "bar"],
                         ["open", "close", "volume"], F.lit(1344.0))


@query("flt9_coverage", sql("""
SELECT role, feature, round(share,6) AS share, share < 0.5 AS breach FROM (
 SELECT CASE WHEN day(session_date)<=15 THEN 'D' ELSE 'V' END AS role,
  unnest(['b0_close','b1_close','b2_trades']) AS feature,
  unnest([count(b0_close), count(b1_close), count(b2_trades)])/count(*)::DOUBLE AS share FROM feat GROUP BY 1)""", FEATURES_SQL))
def _(spark, d):
    f = features(spark, d).withColumn("role", F.when(F.dayofmonth("session_date") <= 15, "D").otherwise("V"))
    names = ["b0_close", "b1_close", "b2_trades"]
    cover = Q.coverage(f.withColumn("b2_trades", F.col("b2_trades").cast("double")), names, ["role"])
    bad = Q.coverage_breaches(cover, dict.fromkeys(names, 0.5)).select("role", "feature", F.lit(True).alias("_b"))
    return cover.join(bad, ["role", "feature"], "left").select(
        "role", "feature", "share", F.coalesce("_b", F.lit(False)).alias("breach"))


@query("flt10_nested_completeness", sql("""
SELECT origin_id, coalesce(target>0,false) AS target_complete, coalesce(target>0 AND b0_close>0,false) AS b0_complete,
  coalesce(target>0 AND b0_close>0 AND b1_close>0,false) AS b1_complete,
  coalesce(target>0 AND b0_close>0 AND b1_close>0 AND b2_trades>0,false) AS b2_complete,
  CASE WHEN NOT coalesce(target>0,false) THEN 'TARGET_INCOMPLETE' WHEN NOT coalesce(b0_close>0,false) THEN 'B0_INCOMPLETE'
   WHEN NOT coalesce(b1_close>0,false) THEN 'B1_INCOMPLETE' WHEN NOT coalesce(b2_trades>0,false) THEN 'B2_INCOMPLETE' ELSE 'NONE' END AS reason
FROM feat""", FEATURES_SQL))
def _(spark, d):
    flags, reason = Q.nested_completeness([
        ("target", F.col("target") > 0), ("b0", F.col("b0_close") > 0), ("b1", F.col("b1_close") > 0),
        ("b2", F.col("b2_trades") > 0)])
    return features(spark, d).select("origin_id", *flags, reason.alias("reason"))


@query("flt11_common_mask", sql("""
SELECT origin_id, coalesce(target>0,false) AND b0_close IS NOT NULL AS evaluated FROM feat""", FEATURES_SQL))
def _(spark, d):
    return features(spark, d).select("origin_id", Q.common_mask(
        "target", ["asset", "session_date", "minute"], ["b0_close"]).alias("evaluated"))


@query("flt12_purge_embargo", sql("""
SELECT asset, count(*) AS rows, max(origin_us) AS last_us FROM origins
WHERE origin_us <= epoch_us(TIMESTAMP '2024-01-18') - 5400000000 GROUP BY 1"""))
def _(spark, d):
    start = date_micros(F.lit("2024-01-18").cast("date"))
    return Q.purge(X.origins(spark, d), start, 30, 60, 30).groupBy("asset").agg(
        F.count(F.lit(1)).alias("rows"), F.max("origin_us").alias("last_us"))


def _asset_quality(spark, d):
    b = X.bars(spark, d)
    return b.groupBy("asset").agg(
        F.least(F.count(F.lit(1)) / 1000.0, F.lit(1.0)).alias("completeness"),
        F.lit(0.0).alias("duplicate_rate"), F.lit(0.0).alias("null_rate"),
        F.min("session_date").alias("history_start"), F.max("session_date").alias("history_end"))


@query("flt13_asset_freeze", sql("""
SELECT asset, max(a) OVER ()::VARCHAR AS common_start, min(b) OVER ()::VARCHAR AS common_end FROM (
 SELECT asset, least(count(*)/1000.0::DOUBLE,1.0) AS c, min(session_date) AS a, max(session_date) AS b FROM bars GROUP BY 1
 HAVING least(count(*)/1000.0::DOUBLE,1.0)>=0.9 ORDER BY c DESC, b-a DESC, asset LIMIT 4)"""))
def _(spark, d):
    return Q.freeze_assets(_asset_quality(spark, d), 2, 4, 0.9)


@query("flt14_continuity", sql("""
SELECT 0::BIGINT AS duplicated, (SELECT count(*) FROM cal, assets WHERE (session_date, asset) NOT IN (SELECT (session_date, asset) FROM tape)) AS missing,
 0::BIGINT AS unexpected, (SELECT count(*) FROM (SELECT session_date, asset FROM tape GROUP BY ALL HAVING count(*)<=60)) AS failing,
 CASE WHEN (SELECT count(*) FROM cal, assets WHERE (session_date, asset) NOT IN (SELECT (session_date, asset) FROM tape))>0 THEN 'INCOMPLETE' WHEN EXISTS (SELECT 1 FROM tape GROUP BY session_date, asset HAVING count(*)<=60) THEN 'PROVIDER_FAILURE' ELSE 'PASS' END AS verdict"""))
def _(spark, d):
    rows = X.tape(spark, d).groupBy("session_date", "asset").agg((F.count(F.lit(1)) > 60).alias("ok"))
    want = X.calendar(spark, d).select("session_date", F.explode(F.array(*[F.lit(a) for a in X.ASSETS])).alias("asset"))
    return Q.continuity_verdict(rows, want, ["session_date", "asset"], ["ok"])


ROLES = [("D", "2024-01-15"), ("V", "2024-01-24"), ("C", "2024-12-31")]


@query("flt15_sealed_guard", sql("""
SELECT asset, count(*) AS rows FROM tape WHERE session_date <= DATE '2024-01-24' GROUP BY 1"""))
def _(spark, d):
    t = X.tape(spark, d).where(F.col("session_date") <= F.lit("2024-01-24").cast("date"))
    roles = X.calendar(spark, d).select("session_date", Q.assign_role(F.col("session_date"), ROLES).alias("role"))
    return Q.refuse_sealed(t, roles, "C").groupBy("asset").agg(F.count(F.lit(1)).alias("rows"))


@query("flt15_sealed_findings", sql("""
SELECT asset, count(*) AS rows, count(*) FILTER (role='C') AS sealed_rows, count(*) FILTER (role IS NULL) AS rows_without_role, (min(session_date) FILTER (role='C'))::VARCHAR AS first_sealed,
 count(DISTINCT session_date) FILTER (role='C') AS sealed_days, CASE WHEN count(*) FILTER (role='C')>0 THEN 'REFUSED' WHEN count(*) FILTER (role IS NULL)>0 THEN 'UNASSIGNED' ELSE 'PASS' END AS verdict
FROM tape LEFT JOIN (SELECT session_date, CASE WHEN session_date<=DATE '2024-01-15' THEN 'D' WHEN session_date<=DATE '2024-01-24' THEN 'V' WHEN session_date<=DATE '2024-12-31' THEN 'C' END AS role FROM cal) USING (session_date) GROUP BY 1"""))
def _(spark, d):
    """The guard over the whole tape, which has sealed days."""
    roles = X.calendar(spark, d).select("session_date", Q.assign_role(F.col("session_date"), ROLES).alias("role"))
    return Q.sealed_findings(X.tape(spark, d), roles, "C", ["asset"])


@query("flt16_session_bounds", sql("""
SELECT asset, count(*) AS origins, count(*) FILTER (minutes>0 AND executed_us>=open_us AND executed_us<=open_us+minutes*60000000) AS inside,
 count(*) FILTER (minutes>0 AND executed_us<open_us) AS before_open, count(*) FILTER (minutes>0 AND executed_us>open_us+minutes*60000000) AS after_close,
 count(*) FILTER (minutes=0) AS no_session FROM tape JOIN cal USING (session_date) GROUP BY 1"""))
def _(spark, d):
    t = X.tape(spark, d).withColumn("origin_us", F.col("executed_us"))
    return Q.session_bounds_audit(t, X.calendar(spark, d))


@query("flt17_causal_audit", sql("""
SELECT fold, count(*) FILTER (session_date<=train_end) AS raw_rows, count(*) FILTER (session_date<=train_end AND origin_us<=ft-3600000000) AS retained_rows,
 count(*) FILTER (session_date BETWEEN test_start AND test_end) AS test_rows,
 (max(ft)-max(origin_us) FILTER (session_date<=train_end AND origin_us<=ft-3600000000))/60e6::DOUBLE AS gap_minutes, true AS causal_pass
FROM origins, (SELECT f.*, (SELECT min(origin_us) FROM origins WHERE session_date BETWEEN test_start AND test_end) AS ft FROM folds f) GROUP BY 1""", FOLD_SQL))
def _(spark, d):
    return Q.causal_audit(X.origins(spark, d), FOLDS, 30, 30)


@query("flt18_role_assignment", sql("""
SELECT role, min(session_date)::VARCHAR AS first, max(session_date)::VARCHAR AS last, true AS ordered FROM (SELECT session_date,
 CASE WHEN session_date<=DATE '2024-01-15' THEN 'D' WHEN session_date<=DATE '2024-01-24' THEN 'V' ELSE 'C' END AS role FROM tape) GROUP BY 1"""))
def _(spark, d):
    t = X.tape(spark, d).select("session_date", Q.assign_role(F.col("session_date"), ROLES).alias("role"))
    return Q.role_order(t, "role", "session_date")


@query("flt19_missing_slots", sql("""
SELECT coalesce(g.asset,b.asset) AS asset, coalesce(g.session_date,b.session_date)::VARCHAR AS session_date, count(g.bar) AS expected,
 count(*) FILTER (g.bar IS NOT NULL AND b.bar IS NOT NULL) AS observed, count(*) FILTER (b.bar IS NULL) AS missing, count(*) FILTER (g.bar IS NULL) AS extra
FROM grid0 g FULL JOIN bars b ON g.asset=b.asset AND g.session_date=b.session_date AND g.bar=b.bar GROUP BY 1,2"""))
def _(spark, d):
    slots = (
        X.calendar(spark, d).where(F.col("minutes") >= 30)
        .withColumn("bar", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("minutes") / 30).cast("bigint") - 1)))
        .withColumn("asset", F.explode(F.array(*[F.lit(a) for a in X.ASSETS]))))
    return Q.slot_diagnostics(X.bars(spark, d), slots, ["asset", "session_date", "bar"], ["asset", "session_date"])

