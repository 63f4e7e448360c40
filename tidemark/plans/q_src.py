"""Queries over scans, payload ingest and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads as P
from ..sources import results as R
from ..sources import tape as S
from . import standin as X
from .registry import query
from .standin import sql


_stores: dict[tuple[str, str], str] = {}


def tape_store(spark, d):
    """The tape written as a ``date=/asset=`` store, a file per partition, once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        t = X.tape(spark, d)
        rows = t.select(
            F.col("id").cast("string").alias("id"), F.concat_ws("|", "asset", F.col("contract").cast("string")).alias("option_chain_id"),
            F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("executed_us").alias("executed_at"),
            F.col("bid").alias("nbbo_bid"), F.col("ask").alias("nbbo_ask"), "size", "premium", F.col("iv").alias("implied_volatility"), "expiry", "strike",
            "option_type", "tags", F.col("flags").alias("report_flags"), "multi_vol", F.col("session_date").alias("date"), "asset")
        path = R.shared_folder(spark)
        R.write_rows(rows.repartition("date", "asset"), path, ["date", "asset"])
        _stores[key] = path
    return _stores[key]


@query("src1_partitioned_scan", sql("""
SELECT id::VARCHAR AS id, asset, created_us, premium FROM tape WHERE session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND asset IN ('click','view') AND size>0"""))
def _(spark, d):
    """Partitions outside the dates and assets are never listed, columns not asked for never read."""
    where = F.col("date").between("2024-01-08", "2024-01-12") & F.col("asset").isin("click", "view") & (F.col("size") > 0)
    t = S.read_tape(spark, tape_store(spark, d), ["id", "asset", "created_at", "premium"], where=where)
    return t.select("id", "asset", F.unix_micros("created_at").alias("created_us"), "premium")


@query("src1_tape_scan", sql("""
SELECT id, asset, executed_us, created_us, size, premium, iv, strike, option_type FROM tape
WHERE size>0 AND strike IS NOT NULL AND iv BETWEEN 0.01 AND 5"""))
def _(spark, d):
    return S.usable_trades(X.tape(spark, d)).select(
        "id", "asset", "executed_us", "created_us", "size", "premium", "iv", "strike", "option_type")


@query("src1_scan_outcome", sql("""
SELECT c.session_date::VARCHAR AS session_date, a.asset, coalesce(n,0)::BIGINT AS rows,
  CASE WHEN n>0 THEN 'measured' ELSE 'sparse' END AS outcome
FROM cal c CROSS JOIN assets a LEFT JOIN (SELECT session_date, asset, count(*) n FROM tape
  WHERE size>0 AND strike IS NOT NULL AND iv BETWEEN 0.01 AND 5 GROUP BY 1,2) t
  ON t.session_date=c.session_date AND t.asset=a.asset"""))
def _(spark, d):
    want = X.calendar(spark, d).select(
        "session_date", F.explode(F.array(*[F.lit(a) for a in X.ASSETS])).alias("asset"))
    return S.scan_outcome(want, S.usable_trades(X.tape(spark, d)), ["session_date", "asset"])


@query("src2_partition_inventory", sql("""
SELECT session_date::VARCHAR AS session_date, asset, 1::BIGINT AS files, count(*) AS rows,
  CASE WHEN day(session_date)<=15 THEN 'D' WHEN day(session_date)<=24 THEN 'V' ELSE 'C' END AS role
FROM tape GROUP BY 1,2,5"""))
def _(spark, d):
    store = spark.read.schema(S.TAPE_SCHEMA).parquet(tape_store(spark, d))
    scan = store.select("*", "_metadata", F.col("date").alias("session_date"))
    dom = F.dayofmonth("session_date")
    role = F.when(dom <= 15, "D").when(dom <= 24, "V").otherwise("C")
    return S.partition_inventory(scan, ["session_date", "asset"], role).drop("bytes")


@query("src3_union_stores", sql("""
SELECT asset, session_date::VARCHAR AS session_date, bar, close, volume, 'a' AS source,
  CASE WHEN day(session_date)<=15 THEN 'D' ELSE 'V' END AS role FROM bars
UNION ALL SELECT asset, session_date::VARCHAR, bar, close, NULL, 'b',
  CASE WHEN day(session_date)<=15 THEN 'D' ELSE 'V' END FROM bars"""))
def _(spark, d):
    b = X.bars(spark, d).select("asset", "session_date", "bar", "close", "volume")
    role = F.when(F.dayofmonth("session_date") <= 15, "D").otherwise("V")
    return S.union_stores({"a": b, "b": b.drop("volume")}, role)


@query("src4_normalise_bars", sql("""
SELECT asset, (w::DATE)::VARCHAR AS session_date, hour(w)*60+minute(w)-570 AS minute, price AS close
FROM (SELECT asset, price, timezone('America/New_York', timezone('UTC', make_timestamp(executed_us))) AS w FROM tape)
WHERE hour(w)*60+minute(w) >= 570"""))
def _(spark, d):
    rows = X.tape(spark, d).select(
        "asset", F.timestamp_micros("executed_us").alias("timestamp_utc"), F.col("price").alias("close"))
    cal = rows.select(F.to_date(F.from_utc_timestamp("timestamp_utc", "America/New_York")).alias(
        "session_date")).distinct().withColumn("open_minute", F.lit(570))
    return S.normalise_bars(rows, cal, "America/New_York").select(
        "asset", "session_date", "minute", "close")


def _minute_payload(spark, d):
    """Bars of one asset and session as one vendor payload text."""
    b = X.bars(spark, d).withColumn(
        "date", F.concat_ws(" ", F.col("session_date").cast("string"), F.format_string(
            "%02d:%02d:00", F.floor(F.col("bar") / 2), (F.col("bar") % 2) * 30)))
    row = F.struct("date", "open", "high", "low", "close", "volume")
    return b.groupBy("asset", "session_date").agg(F.to_json(F.collect_list(row)).alias("payload"))


@query("src5_minute_payload", sql("""
SELECT asset, session_date::VARCHAR AS session_date, open, high, low, close, volume,
  (epoch_us(session_date::TIMESTAMP) + bar*1800000000 + 18000000000)::BIGINT AS start_us,
  (epoch_us(session_date::TIMESTAMP) + bar*1800000000 + 18060000000)::BIGINT AS available_us FROM bars"""))
def _(spark, d):
    out = P.minute_bars(_minute_payload(spark, d).select("asset", "payload"), "payload", ["asset"],
                        "America/New_York")
    return out.select("asset", "session_date", "open", "high", "low", "close", "volume",
                      F.unix_micros("bar_start").alias("start_us"),
                      F.unix_micros("available_at").alias("available_us"))


@query("src6_earnings_payload", """
SELECT 'C' || c_custkey AS symbol, min(CAST(o_orderdate AS DATE))::VARCHAR AS event_date,
  round(max(c_acctbal),6)::DOUBLE AS eps_actual, 'date_only' AS timestamp_quality
FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey""")
def _(spark, d):
    o = X.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("day"))
    c = X.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    row = F.struct(F.concat(F.lit("C"), "c_custkey").alias("symbol"),
                   F.col("day").cast("string").alias("date"), F.col("c_acctbal").alias("epsActual"))
    return P.earnings(c.select(F.to_json(F.array(row)).alias("p")), "p").select(
        "symbol", "event_date", F.col("epsActual").alias("eps_actual"), "timestamp_quality")


@query("src7_flow_alerts", sql("""
SELECT id::VARCHAR AS id, asset AS ticker, executed_us//1000*1000 AS start_us, option_type,
  flags='sweep' AS has_sweep, CASE WHEN ask=bid OR price>=ask THEN 'ask' WHEN price<=bid THEN 'bid'
  ELSE 'mid' END AS execution_proxy FROM tape"""))
def _(spark, d):
    t = X.tape(spark, d)
    row = F.struct(
        F.col("id").cast("string").alias("id"), F.col("asset").alias("ticker"),
        F.floor(F.col("executed_us") / 1000).alias("start_time"),
        F.floor(F.col("created_us") / 1000).alias("created_at"),
        F.initcap("option_type").alias("type"), "price", "bid", "ask", "strike",
        (F.col("flags") == "sweep").alias("has_sweep"))
    p = t.select(F.to_json(F.struct(F.array(row).alias("data"))).alias("p"))
    return P.flow_alerts(p, "p").select(
        "id", "ticker", F.unix_micros("start_at").alias("start_us"), "option_type", "has_sweep",
        "execution_proxy")


@query("src8_quotes_and_trades", sql("""
SELECT asset, 'quote' AS kind, executed_us*1000+id%1000 AS sip_ns, bid AS a, CASE WHEN id%5=0 THEN NULL ELSE ask END AS b,
  id%5<>0 AS has_quote, 2::BIGINT AS conditions FROM tape
UNION ALL SELECT asset, 'trade', executed_us*1000+id%1000, price, size::DOUBLE, NULL, 1 FROM tape"""))
def _(spark, d):
    t = X.tape(spark, d)
    ns = (F.col("executed_us") * 1000 + F.col("id") % 1000).alias("sip_timestamp")
    q = F.struct(ns, F.col("bid").alias("bid_price"),
                 F.when(F.col("id") % 5 != 0, F.col("ask")).alias("ask_price"),
                 F.array(F.lit("R"), F.lit("1")).alias("conditions"))
    r = F.struct(ns, "price", "size", F.array(F.lit("@")).alias("conditions"))
    qs = P.quotes(t.select("asset", F.to_json(F.struct(F.array(q).alias("results"))).alias("p")),
                  "p", ["asset"])
    ts = P.trades(t.select("asset", F.to_json(F.struct(F.array(r).alias("results"))).alias("p")),
                  "p", ["asset"])
    a = qs.select("asset", F.lit("quote").alias("kind"), F.col("sip_timestamp").alias("sip_ns"),
                  F.col("bid_price").alias("a"), F.col("ask_price").alias("b"), "has_quote",
                  F.size("conditions").cast("bigint").alias("conditions"))
    b = ts.select("asset", F.lit("trade").alias("kind"), F.col("sip_timestamp").alias("sip_ns"),
                  F.col("price").alias("a"), F.col("size").cast("double").alias("b"),
                  F.lit(None).cast("boolean").alias("has_quote"),
                  F.size("conditions").cast("bigint").alias("conditions"))
    return a.unionByName(b)


def receipts(spark, d):
    """Two overlapping polls per record; one record in eleven is never received."""
    t = X.tape(spark, d)
    at = F.when(F.col("id") % 11 != 0, F.col("created_us") + 31_000_000)
    return t.select("id", F.col("id").cast("string").alias("record_id"), "asset", "executed_us",
                    "created_us", F.explode(F.array(at, at + 60_000_000)).alias("received_us"))


@query("src9_first_receipts", sql("""
SELECT id::VARCHAR AS record_id, CASE WHEN id%11<>0 THEN created_us+31000000 END AS received_us,
  CASE WHEN id%11<>0 THEN created_us END AS created_us, 2::BIGINT AS receipts FROM tape"""))
def _(spark, d):
    return P.first_receipts(receipts(spark, d))


@query("src10_daily_archive", sql("""
SELECT id::VARCHAR AS id, asset AS underlying_symbol, size, premium FROM tape WHERE asset IN ('click','view')"""))
def _(spark, d):
    t = X.tape(spark, d).select(F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), F.col("asset").alias("underlying_symbol"), "size",
        "premium")).alias("line"))
    schema = "id string, underlying_symbol string, size bigint, premium double"
    return P.archive_rows(t, "line", schema, ["click", "view"])


@query("src11_yield_curve", """
SELECT CAST(o_orderdate AS DATE)::VARCHAR AS rate_date, round(count(*)/100.0::DOUBLE/100.0::DOUBLE,6) AS rate
FROM orders GROUP BY CAST(o_orderdate AS DATE)""")
def _(spark, d):
    day = X.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        (F.count(F.lit(1)) / 100.0).alias("rate"))
    doc = F.format_string(
        "<properties><NEW_DATE>%sT00:00:00</NEW_DATE><BC_1MONTH>%s</BC_1MONTH></properties>",
        F.col("day").cast("string"), F.col("rate").cast("string"))
    return P.yield_curve(day.select(doc.alias("x")), "x")


@query("src12_parquet_sink", sql("""
SELECT asset, session_date::VARCHAR AS session_date, count(*) AS rows, round(sum(close),6) AS close_sum
FROM bars GROUP BY ALL"""))
def _(spark, d):
    path = R.shared_folder(spark)
    R.write_rows(X.bars(spark, d), path, ["asset"])
    return spark.read.parquet(path).groupBy("asset", "session_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close_sum"))


@query("src14_adhoc_sql", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
  round(sum(l_extendedprice*(1-l_discount)),4) AS revenue, count(*) AS n
FROM lineitem GROUP BY 1,2""")
def _(spark, d):
    return R.run_sql(spark, f"{d}/lineitem.parquet", "lineitem_adhoc", """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
          round(sum(l_extendedprice*(1-l_discount)),4) AS revenue, count(*) AS n
        FROM lineitem_adhoc GROUP BY 1,2""")


@query("src15_timestamp_scan", sql("""
SELECT asset, count(*) AS rows, min(executed_us) AS first_us, max(created_us) AS last_us,
  count(*) FILTER (created_us<executed_us) AS negative FROM tape GROUP BY 1"""))
def _(spark, d):
    return S.timestamp_scan(X.tape(spark, d), ("asset", "executed_us", "created_us")).groupBy(
        "asset").agg(F.count(F.lit(1)).alias("rows"), F.min("executed_us").alias("first_us"),
                     F.max("created_us").alias("last_us"),
                     F.count_if(F.col("created_us") < F.col("executed_us")).alias("negative"))


@query("src16_versioned_results", """
SELECT o_custkey AS subject, max(o_orderkey) AS run_id, count(*) AS versions,
  arg_max(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey)) AS value FROM
  (SELECT * , row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) rn FROM orders)
GROUP BY 1""".replace("max(o_orderkey) AS run_id", "max(CASE WHEN rn=1 THEN o_orderkey END) AS run_id"))
def _(spark, d):
    h = X.table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("run_id"),
        F.to_date("o_orderdate").alias("at"), F.col("o_totalprice").alias("value"))
    return R.current_results(h, ["subject"], ["at", "run_id"]).drop("at")


@query("src16_appended_runs", """
SELECT subject, arg_max(value, run_id) AS value, max(run_id) AS run_id, count(*) AS versions FROM
  (SELECT o_custkey AS subject, round(sum(o_totalprice),2) AS value, '1' AS run_id FROM orders WHERE o_orderdate<TIMESTAMP '1998-01-01' GROUP BY 1
   UNION ALL SELECT o_custkey, round(sum(o_totalprice),2), '2' FROM orders WHERE o_orderdate>=TIMESTAMP '1998-01-01' GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    path, late = R.shared_folder(spark), F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    orders = X.table(spark, d, "orders")
    for run_id, rows in (("1", orders.where(~late)), ("2", orders.where(late))):
        R.append_results(rows.groupBy(F.col("o_custkey").alias("subject")).agg(F.round(F.sum("o_totalprice"), 2).alias("value")), path, run_id)
    history = spark.read.schema("subject bigint, value double, run_id string").parquet(path)
    return R.current_results(history, ["subject"], ["run_id"]).select("subject", "value", "run_id", "versions")


@query("src17_merged_panel", sql("""
SELECT o.origin_id, o.asset, o.session_date::VARCHAR AS session_date, o.minute, b.close AS b0_close,
  t.n AS b2_trades FROM origins o
LEFT JOIN bars b ON b.asset=o.asset AND b.session_date=o.session_date AND b.bar=o.minute//30-1
LEFT JOIN (SELECT asset, session_date, (executed_us%86400000000)//1800000000+1 AS k, count(*) n FROM tape GROUP BY 1,2,3) t
  ON t.asset=o.asset AND t.session_date=o.session_date AND t.k=o.minute//30"""))
def _(spark, d):
    keys = ["asset", "session_date", "minute"]
    b0 = X.bars(spark, d).select("asset", "session_date", ((F.col("bar") + 1) * 30).alias("minute"),
                                 F.col("close").alias("b0_close"))
    b2 = X.tape(spark, d).groupBy(
        "asset", "session_date",
        ((F.floor(F.pmod("executed_us", F.lit(86_400_000_000)) / X.SLOT_US) + 1) * 30).alias("minute"),
    ).agg(F.count(F.lit(1)).alias("b2_trades"))
    return S.merged_panel(X.origins(spark, d), b0, b2, keys).select(
        "origin_id", *keys, "b0_close", "b2_trades")
