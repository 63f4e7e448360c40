"""The library's inputs derived from the shared test tables, in Spark and in check SQL.

Every mapping is integer or date arithmetic on the given tables, so both sides repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import contract_key, ntz_micros
from ..operators.grid import make_bars, origin_grid, session_calendar

ASSETS = ["click", "error", "purchase", "signup", "view"]
BAR_MINUTES = 30
SLOT_US = BAR_MINUTES * 60_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tape(spark: SparkSession, d: str) -> DataFrame:
    return tape_of(table(spark, d, "events"))


def tape_of(events: DataFrame) -> DataFrame:
    """events, batch or stream, as an option trade tape with two clocks."""
    e = F.col("event_id")
    u = F.col("user_id")
    day = F.to_date("ts")
    expiry = F.date_add(day, (F.lit(7) * (u % 5)).cast("int"))
    strike = (F.lit(80) + F.lit(5) * (u % 9)).cast("double")
    is_call = e % 2 == 0
    value = F.col("value")
    return events.select(
        e.alias("id"),
        F.col("event_type").alias("asset"),
        u.alias("account"),
        day.alias("session_date"),
        ntz_micros("ts").alias("executed_us"),
        (
            ntz_micros("ts")
            + (e * 37) % 1000 * 10_000
            + F.when(e % 97 == 0, 300_000_000).otherwise(0)
        ).alias("created_us"),
        (value * 0.98).alias("bid"),
        F.when(e % 41 == 0, value * 0.98).otherwise(value * 1.02).alias("ask"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
        value.alias("premium"),
        value.alias("price"),
        (F.lit(0.10) + (e % 60) / 100.0).alias("iv"),
        expiry.alias("expiry"),
        strike.alias("strike"),
        F.when(is_call, "call").otherwise("put").alias("option_type"),
        F.when(e % 3 == 0, "ask_side").when(e % 3 == 1, "bid_side").otherwise("none").alias("tags"),
        F.when(e % 7 == 0, "sweep").otherwise("").alias("flags"),
        ((e % 50) * 10).cast("double").alias("multi_vol"),
        contract_key(expiry, strike, is_call).alias("contract"),
    )


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Days of events; day-of-month multiples of 13 are holidays, Sundays close early."""
    days = table(spark, d, "events").select(F.to_date("ts").alias("session_date"))
    c = F.col("session_date")
    return session_calendar(days, F.dayofmonth(c) % 13 == 0, F.dayofweek(c) == 1)


def bars(spark: SparkSession, d: str) -> DataFrame:
    return make_bars(tape(spark, d).where(F.col("price") > 0), BAR_MINUTES)


def origins(spark: SparkSession, d: str) -> DataFrame:
    """Half-hourly origins, open+30 .. close-30."""
    return origin_grid(calendar(spark, d), ASSETS, 30, 30, 30)


def orders_series(spark: SparkSession, d: str) -> DataFrame:
    """orders as a daily forecast/loss panel: asset = priority, session = order date."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    actual = F.sqrt("o_totalprice") / 10.0 + 1.0
    return o.select(
        k.alias("origin_id"),
        F.col("o_orderpriority").alias("asset"),
        F.to_date("o_orderdate").alias("session_date"),
        actual.alias("actual"),
        (actual * (1.0 + ((k * 7) % 11 - 5) / 20.0)).alias("f_base"),
        (actual * (1.0 + ((k * 13) % 9 - 4) / 22.0)).alias("f_wide"),
        F.col("o_custkey").alias("account"),
    )


PRELUDE = """
WITH tape AS (
  SELECT event_id AS id, event_type AS asset, user_id AS account, CAST(ts AS DATE) AS session_date,
    epoch_us(ts) AS executed_us,
    epoch_us(ts) + ((event_id*37)%1000)*10000
      + CASE WHEN event_id%97=0 THEN 300000000 ELSE 0 END AS created_us,
    value*0.98::DOUBLE AS bid,
    CASE WHEN event_id%41=0 THEN value*0.98::DOUBLE ELSE value*1.02::DOUBLE END AS ask,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS size, value AS premium, value AS price,
    0.10::DOUBLE + (event_id%60)/100.0::DOUBLE AS iv,
    CAST(ts AS DATE) + CAST(7*(user_id%5) AS INTEGER) AS expiry,
    CAST(80+5*(user_id%9) AS DOUBLE) AS strike,
    CASE WHEN event_id%2=0 THEN 'call' ELSE 'put' END AS option_type,
    CASE event_id%3 WHEN 0 THEN 'ask_side' WHEN 1 THEN 'bid_side' ELSE 'none' END AS tags,
    CASE WHEN event_id%7=0 THEN 'sweep' ELSE '' END AS flags,
    CAST((event_id%50)*10 AS DOUBLE) AS multi_vol,
    CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE) + CAST(7*(user_id%5) AS INTEGER)) AS BIGINT)*20000000
      + (80+5*(user_id%9))*2000 + CASE WHEN event_id%2=0 THEN 1 ELSE 0 END AS contract
  FROM events),
cal AS (
  SELECT CAST(d AS DATE) AS session_date,
    CAST(CASE WHEN day(d)%13=0 THEN 0 WHEN dayofweek(d)=0 THEN 720 ELSE 1440 END AS BIGINT) AS minutes,
    epoch_us(CAST(d AS TIMESTAMP)) AS open_us
  FROM (SELECT unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP),
        CAST(max(CAST(ts AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM events)),
assets AS (SELECT unnest(['click','error','purchase','signup','view']) AS asset),
bars AS (
  SELECT asset, session_date, (executed_us % 86400000000)//1800000000 AS bar,
    arg_min(price, (executed_us, id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (executed_us, id)) AS close, CAST(sum(size) AS DOUBLE) AS volume
  FROM tape WHERE price > 0 GROUP BY 1,2,3),
grid0 AS (
  SELECT asset, session_date, bar, minutes//30 AS slots, open_us FROM (
    SELECT session_date, minutes, open_us, unnest(generate_series(0, minutes//30-1)) AS bar
    FROM cal WHERE minutes>=30), assets),
grid AS (
  SELECT g.asset, g.session_date, g.bar, g.slots, g.open_us, b.open,
    b.close IS NOT NULL AS observed,
    last_value(b.close IGNORE NULLS) OVER w AS close,
    coalesce(b.high, last_value(b.close IGNORE NULLS) OVER w) AS high,
    coalesce(b.low, last_value(b.close IGNORE NULLS) OVER w) AS low,
    coalesce(b.volume, 0.0::DOUBLE) AS volume,
    avg(CASE WHEN b.close IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
      OVER (PARTITION BY g.asset, g.session_date) AS fill_share
  FROM grid0 g LEFT JOIN bars b USING (asset, session_date, bar)
  WINDOW w AS (PARTITION BY g.asset, g.session_date ORDER BY g.bar
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rets AS (
  SELECT *, ln(close/lag(close) OVER (PARTITION BY asset, session_date ORDER BY bar)) AS r FROM grid),
origins AS (
  SELECT asset, session_date, minute, open_us + minute*60000000 AS origin_us,
    asset || ':' || CAST(open_us + minute*60000000 AS VARCHAR) AS origin_id
  FROM (SELECT session_date, open_us, unnest(generate_series(30, minutes-30, 30)) AS minute
        FROM cal WHERE minutes >= 60), assets),
panel AS (
  SELECT o_orderkey AS origin_id, o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS session_date,
    sqrt(o_totalprice)/10.0::DOUBLE + 1.0::DOUBLE AS actual,
    (sqrt(o_totalprice)/10.0::DOUBLE + 1.0::DOUBLE)*(1.0::DOUBLE+((o_orderkey*7)%11-5)/20.0::DOUBLE) AS f_base,
    (sqrt(o_totalprice)/10.0::DOUBLE + 1.0::DOUBLE)*(1.0::DOUBLE+((o_orderkey*13)%9-4)/22.0::DOUBLE) AS f_wide,
    o_custkey AS account
  FROM orders)
"""


def sql(body: str, *ctes: str) -> str:
    """The shared CTEs, extra ones, and a body."""
    extra = "".join(",\n" + c for c in ctes)
    return PRELUDE.strip() + extra + "\n" + body


def loss_series(spark: SparkSession, d: str) -> DataFrame:
    """Loss-difference series per order priority, one row a session: series, session_date, value, origins, idx."""
    from ..functions.columns import qlike
    from ..operators.series import session_series

    p = orders_series(spark, d)
    diff = qlike(F.col("actual"), F.col("f_base")) - qlike(F.col("actual"), F.col("f_wide"))
    return session_series(p.select(F.col("asset").alias("series"), "session_date", diff.alias("diff")), ["series"], "diff")


SERIES_SQL = """series AS (
  SELECT asset AS series, session_date, avg(actual/f_base-ln(actual/f_base)-(actual/f_wide-ln(actual/f_wide))) AS value,
    count(*) AS origins, row_number() OVER (PARTITION BY asset ORDER BY session_date)-1 AS idx
  FROM panel GROUP BY 1,2)"""
