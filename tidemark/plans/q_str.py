"""Queries over streams and the Python function surface.

Streams read the table as landed files and run to completion.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import udf as U
from ..functions.columns import with_scalars
from ..operators.joins import event_neighbourhood
from ..sources.results import shared_folder
from ..streaming import run as RUN
from ..streaming import state as ST
from ..streaming import windows as W
from . import panels as PN
from . import standin as X
from .registry import query
from .standin import sql


def tape_stream(spark, d):
    """The tape as files that land one after the other, a micro-batch each."""
    events = X.table(spark, d, "events")
    return W.event_times(X.tape_of(RUN.files_as_stream(spark, landed(spark, d), "*.parquet", events.schema, 1)))


_landed: dict[tuple[str, str], str] = {}


def landed(spark, d, files=4):
    """A folder with the events in ``files`` files by time, written in that order, once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _landed:
        events = X.table(spark, d, "events")
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        cuts = events.agg(F.percentile_approx(at, [k / files for k in range(1, files)])).first()[0] or []
        part = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
        folder = shared_folder(spark)
        for k in range(len(cuts) + 1):
            events.where(part == k).coalesce(1).write.mode("append").parquet(folder)
        _landed[key] = folder
    return _landed[key]


def finish(spark, stream, mode="append"):
    return RUN.read_back(spark, RUN.run_available(stream, mode), stream.schema)


def _us(c):
    return F.unix_micros(c)


MAXT = "(SELECT (max(executed_us)//1000)*1000 FROM tape)"


@query("str1_tumbling_activity", sql(f"""
SELECT asset, s AS start_us, count(*) AS trades, round(sum(premium),4) AS premium, max(premium) AS max_premium FROM (SELECT *, (executed_us//1800000000)*1800000000 AS s FROM tape) WHERE created_us<=s+1800000000 AND s+1800000000 <= {MAXT}-600000000 GROUP BY 1,2"""))
def _(spark, d):
    out = finish(spark, W.tumbling_activity(tape_stream(spark, d), "30 minutes", "10 minutes"))
    return out.select("asset", _us("w.start").alias("start_us"), "trades", F.round("premium", 4).alias("premium"), "max_premium")


@query("str2_sliding_flow", sql(f"""
SELECT asset, s AS start_us, count(*) AS trades, round(sum(premium*CASE tags WHEN 'ask_side' THEN 1 WHEN 'bid_side' THEN -1 ELSE 0 END),4) AS signed_premium FROM (SELECT *, unnest([(executed_us//1800000000)*1800000000, (executed_us//1800000000)*1800000000-1800000000]) AS s FROM tape)
WHERE created_us<=s+3600000000 AND s+3600000000 <= {MAXT}-600000000 GROUP BY 1,2"""))
def _(spark, d):
    out = finish(spark, W.sliding_flow(tape_stream(spark, d), "60 minutes", "30 minutes", "10 minutes"))
    return out.select("asset", _us("w.start").alias("start_us"), "trades", F.round("signed_premium", 4).alias("signed_premium"))


def receipt_stream(spark, d):
    t = tape_stream(spark, d)
    at = F.col("created_us") + 31_000_000
    return t.select(F.col("id").cast("string").alias("record_id"), F.explode(F.array(at + 60_000_000, at)).alias("r")).select(
        "record_id", F.timestamp_micros("r").alias("received_at"))


@query("str3_first_receipts", sql("""
SELECT id::VARCHAR AS record_id, 2::BIGINT AS receipts, created_us+31000000 AS first_us FROM tape
WHERE created_us+691000000 <= (SELECT ((max(created_us)+91000000)//1000)*1000-600000000 FROM tape)"""))
def _(spark, d):
    out = finish(spark, W.first_receipts(receipt_stream(spark, d), "10 minutes"))
    return out.select("record_id", "receipts", _us("first_received_at").alias("first_us"))


@query("str4_late_accounting", sql("""
SELECT asset, count(*) AS rows, count(*) FILTER (created_us-executed_us>60000000) AS late_rows, count(*) FILTER (created_us>(executed_us//1800000000+1)*1800000000) AS dropped FROM tape GROUP BY 1"""))
def _(spark, d):
    def measure(df):
        end = (F.floor(F.col("executed_us") / X.SLOT_US) + 1) * X.SLOT_US
        return df.groupBy("asset").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("created_us") - F.col("executed_us") > 60_000_000).alias("late_rows"),
                                       F.count_if(F.col("created_us") > end).alias("dropped"))

    out = RUN.account_late(tape_stream(spark, d), measure)
    return spark.read.schema("asset string, rows bigint, late_rows bigint, dropped bigint").parquet(out).groupBy("asset").agg(
        *[F.sum(c).alias(c) for c in ("rows", "late_rows", "dropped")])


@query("str4_batch_ledger", sql("""
SELECT 2*count(*) AS read, count(*) AS kept, count(*) AS not_kept, true AS reconciled, count(*) AS written, count(DISTINCT id) AS ids FROM tape"""))
def _(spark, d):
    """The tape sent twice and kept once: what its micro-batches read, kept and dropped, beside what was written."""
    t = tape_stream(spark, d).select("id", "asset", "executed_at")
    twice = t.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out, ledger = RUN.keep_once(twice, ["id"], "executed_at", "10 minutes")
    written = spark.read.schema(t.schema).parquet(out).agg(F.count(F.lit(1)).alias("written"), F.count_distinct("id").alias("ids"))
    totals = ledger.agg(
        F.sum("read").alias("read"), F.sum("kept").alias("kept"), F.sum(F.col("late") + F.col("repeated")).alias("not_kept"),
        F.bool_and(F.col("read") == F.col("kept") + F.col("late") + F.col("repeated")).alias("reconciled"))
    return with_scalars(totals, written)


@query("str5_latest_per_contract", sql("""
SELECT asset, contract, max(created_us) AS created_us, arg_max(id, (created_us, id)) AS id, round(arg_max(iv, (created_us, id)),6) AS iv FROM tape GROUP BY 1,2"""))
def _(spark, d):
    out = finish(spark, ST.latest_per_contract(tape_stream(spark, d)), "update")
    return out.groupBy("asset", "contract").agg(F.max_by(F.struct("created_us", "id", "iv"), F.struct("created_us", "id")).alias("r")).select(
        "asset", "contract", "r.*")


@query("str6_decay_state", sql("""
SELECT t.asset, at_us, round(sum(exp(-(at_us-executed_us)/3600e6::DOUBLE)),6) AS intensity FROM tape t JOIN (SELECT asset, max(executed_us) AS at_us FROM tape GROUP BY 1) m ON m.asset=t.asset GROUP BY 1,2"""))
def _(spark, d):
    return ST.combine_decay(finish(spark, ST.decay_intensity(tape_stream(spark, d), 3600.0), "update"), 3600.0)


@query("str7_stream_reconciliation", sql("""
SELECT asset, count(*) AS matched, 31.0::DOUBLE AS mean_lag_s FROM tape WHERE id%11<>0 GROUP BY 1"""))
def _(spark, d):
    t = tape_stream(spark, d).withColumn("fp", F.concat_ws("|", "asset", F.col("id").cast("string")))
    r = tape_stream(spark, d).where(F.col("id") % 11 != 0).select(
        F.concat_ws("|", "asset", F.col("id").cast("string")).alias("fp"), F.timestamp_micros(F.col("created_us") + 31_000_000).alias("received_at"))
    out = finish(spark, W.reconcile(r, t.select("asset", "fp", "created_at"), "10 MINUTES", "10 minutes"))
    return out.groupBy("asset").agg(F.count(F.lit(1)).alias("matched"), F.avg((_us("received_at") - _us("created_at")) / 1e6).alias("mean_lag_s"))


@query("str8_heartbeats", sql(f"""
SELECT asset, min(executed_us) AS start_us, max(executed_us)+3600000000 AS end_us, count(*) AS trades FROM (SELECT *, sum(brk) OVER (PARTITION BY asset ORDER BY executed_us, id) AS g FROM
 (SELECT *, CASE WHEN executed_us - lag(executed_us) OVER (PARTITION BY asset ORDER BY executed_us, id) < 3600000000 THEN 0 ELSE 1 END AS brk FROM tape)) GROUP BY asset, g HAVING max(executed_us)+3600000000 <= {MAXT}-600000000"""))
def _(spark, d):
    out = finish(spark, W.heartbeats(tape_stream(spark, d), "60 minutes", "10 minutes"))
    return out.select("asset", _us("w.start").alias("start_us"), _us("w.end").alias("end_us"), "trades")


@query("str9_daily_collection", sql("SELECT session_date::VARCHAR AS session_date, count(*) AS rows, count(DISTINCT id) AS ids FROM tape GROUP BY 1"))
def _(spark, d):
    out, ck = shared_folder(spark), shared_folder(spark)
    for _ in range(2):
        RUN.collect_daily(tape_stream(spark, d).select("id", "asset", "session_date", "premium"), out, ck, "session_date")
    back = spark.read.schema("id bigint, asset string, premium double, batch int, session_date date").parquet(out)
    return back.groupBy("session_date").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


@query("udf1_row_callable_as_join", sql("""
SELECT o.asset, count(*) AS origins, count(*) FILTER (e.session_date IS NOT NULL) AS near FROM origins o LEFT JOIN (SELECT DISTINCT asset, session_date FROM tape WHERE size>=99 AND flags='sweep') e
 ON e.asset=o.asset AND e.session_date=o.session_date GROUP BY 1"""))
def _(spark, d):
    ev = X.tape(spark, d).where((F.col("size") >= 99) & (F.col("flags") == "sweep"))
    o = X.origins(spark, d)
    return event_neighbourhood(o, ev, o, 0).groupBy("asset").agg(F.count(F.lit(1)).alias("origins"), F.count_if("near_event").alias("near"))


@query("udf5_grouped_producer", sql("""
SELECT asset, session_date::VARCHAR AS session_date, round(sum(r*r),6) AS rv, count(r) AS returns FROM rets GROUP BY 1,2 HAVING count(close)>0"""))
def _(spark, d):
    def produce(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("bar")["r"].dropna()
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "session_date": [pdf["session_date"].iloc[0]], "rv": [float((r * r).sum())], "returns": [len(r)]})

    rows = PN.returns(spark, d).where(F.col("valid")).select("asset", "session_date", "bar", "r")
    return U.grouped_producer(rows, ["asset", "session_date"], produce, "asset string, session_date date, rv double, returns bigint")


@query("udf6_origin_table_function", sql("""
SELECT session_date::VARCHAR AS session_date, minute, open_us+minute*60000000 AS origin_us FROM (SELECT session_date, open_us, unnest(generate_series(5, minutes-30, 5)) AS minute FROM cal WHERE minutes>0)"""))
def _(spark, d):
    U.register(spark)
    X.calendar(spark, d).createOrReplaceTempView("tidemark_calendar")
    return spark.sql("SELECT c.session_date, o.minute, o.origin_us FROM tidemark_calendar c, LATERAL session_origins(c.open_us, c.minutes, 5, 30, 5) o")


@query("flagship_flow_and_variance", sql("""
SELECT o.origin_id, o.asset, o.session_date::VARCHAR AS session_date, o.minute, count(t.id) AS trades, round(coalesce(sum(t.premium*CASE tags WHEN 'ask_side' THEN 1 WHEN 'bid_side' THEN -1 ELSE 0 END),0),4) AS signed_premium, round(max(v.rv),6) AS trailing_rv
FROM origins o LEFT JOIN tape t ON t.asset=o.asset AND t.executed_us>=o.origin_us-120000000-1800000000 AND t.created_us<=o.origin_us-120000000
LEFT JOIN (SELECT asset, session_date, (bar+1)*30 AS minute, CASE WHEN count(r) OVER w=2 THEN sum(r*r) OVER w END AS rv FROM rets WINDOW w AS (PARTITION BY asset, session_date ORDER BY bar ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) v
 ON v.asset=o.asset AND v.session_date=o.session_date AND v.minute=o.minute GROUP BY ALL"""))
def _(spark, d):
    return PN.flow_and_variance(spark, d)
