"""Vendor payload text to typed rows, with explicit schemas and fail-fast parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE_SCHEMA = (
    "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>"
)
EARNINGS_SCHEMA = (
    "array<struct<symbol:string,date:string,epsActual:double,epsEstimated:double,"
    "revenueActual:double,revenueEstimated:double,lastUpdated:string>>"
)
ALERT_SCHEMA = (
    "struct<data:array<struct<id:string,ticker:string,option_chain:string,start_time:bigint,"
    "end_time:bigint,created_at:bigint,total_premium:double,total_size:bigint,volume:bigint,"
    "open_interest:bigint,type:string,strike:double,expiry:string,price:double,bid:double,"
    "ask:double,has_sweep:boolean,has_floor:boolean,has_multileg:boolean>>>"
)
QUOTE_SCHEMA = (
    "struct<results:array<struct<sip_timestamp:bigint,bid_price:double,ask_price:double,"
    "conditions:array<string>,participant_timestamp:bigint>>>"
)
TRADE_SCHEMA = (
    "struct<results:array<struct<sip_timestamp:bigint,price:double,size:bigint,"
    "conditions:array<string>>>>"
)
RECEIPT_SCHEMA = "record_id string, executed_at timestamp, created_at timestamp, received_at timestamp"
STRICT = {"mode": "FAILFAST"}


def _parse(text: str | Column, schema: str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.from_json(c, schema, STRICT)


def minute_bars(payloads: DataFrame, text: str, keys: list[str], zone: str) -> DataFrame:
    """One row per bar: UTC instant, session date, usable-from stamps of one and two minutes.

    A duplicate (key, minute), or prices out of order, fails the job.
    """
    rows = (
        payloads.select(*keys, F.explode(_parse(text, MINUTE_SCHEMA)).alias("b"))
        .select(*keys, "b.*")
        .withColumn("bar_start", F.to_utc_timestamp(F.to_timestamp("date"), zone))
        .withColumn("session_date", F.to_date("date"))
    )
    good = (
        (F.col("high") >= F.greatest("open", "close", "low"))
        & (F.col("low") <= F.least("open", "close"))
        & (F.col("low") > 0)
    )
    once = (
        rows.groupBy(*keys, "bar_start", "session_date")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.max(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
        )
        .where(
            F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate bar minute")).cast("boolean"))
            .when(~good, F.raise_error(F.lit("invalid bar prices")).cast("boolean"))
            .otherwise(True)
        )
        .drop("_n")
    )
    return once.withColumn(
        "available_at", F.col("bar_start") + F.expr("INTERVAL 1 MINUTE")
    ).withColumn("available_at_2m", F.col("bar_start") + F.expr("INTERVAL 2 MINUTES"))


def earnings(payloads: DataFrame, text: str) -> DataFrame:
    """Date-only corporate events, marked so that no intraday use is made of them."""
    return (
        payloads.select(F.explode(_parse(text, EARNINGS_SCHEMA)).alias("e"))
        .select("e.*")
        .withColumn("event_date", F.to_date("date"))
        .withColumn("timestamp_quality", F.lit("date_only"))
    )


def flow_alerts(payloads: DataFrame, text: str) -> DataFrame:
    """Alerts with millisecond stamps as instants and the execution side from price vs quote."""
    side = (
        F.when(F.col("bid").isNull() | F.col("ask").isNull() | F.col("price").isNull(), "unknown")
        .when(F.col("price") >= F.col("ask"), "ask")
        .when(F.col("price") <= F.col("bid"), "bid")
        .otherwise("mid")
    )
    return (
        payloads.select(F.explode(_parse(text, ALERT_SCHEMA)["data"]).alias("a"))
        .select("a.*")
        .withColumn("start_at", F.timestamp_millis("start_time"))
        .withColumn("created_ts", F.timestamp_millis("created_at"))
        .withColumn("option_type", F.lower(F.trim("type")))
        .withColumn("execution_proxy", side)
    )


def quotes(payloads: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Quotes with nanosecond stamps kept whole; a missing side stays null, zero stays zero."""
    return (
        payloads.select(*keys, F.explode(_parse(text, QUOTE_SCHEMA)["results"]).alias("q"))
        .select(*keys, "q.*")
        .withColumn("has_quote", F.col("bid_price").isNotNull() & F.col("ask_price").isNotNull())
        .withColumn("sip_at", F.timestamp_micros(F.floor(F.col("sip_timestamp") / 1000).cast("bigint")))
    )


def trades(payloads: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return payloads.select(*keys, F.explode(_parse(text, TRADE_SCHEMA)["results"]).alias("t")).select(
        *keys, "t.*"
    )


def first_receipts(log: DataFrame) -> DataFrame:
    """The earliest receipt of each record, from a receipt log with overlapping polls."""
    return log.groupBy("record_id").agg(
        F.min("received_us").alias("received_us"),
        F.min_by("created_us", "received_us").alias("created_us"),
        F.count(F.lit(1)).alias("receipts"),
    )


def read_receipt_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECEIPT_SCHEMA).json(path)


def read_daily_archive(
    spark: SparkSession, path: str, schema: str, assets: list[str], multiline: bool = False
) -> DataFrame:
    """JSON lines (or a JSON array with ``multiline``), gzip or plain, outcome assets only."""
    df = spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)
    return df.where(F.col("underlying_symbol").isin(assets))


def archive_rows(payloads: DataFrame, text: str, schema: str, assets: list[str]) -> DataFrame:
    """As :func:`read_daily_archive` for text already landed in a table column."""
    parsed = payloads.select(F.from_json(text, schema, STRICT).alias("r")).select("r.*")
    return parsed.where(F.col("underlying_symbol").isin(assets))


YIELD_SCHEMA = "struct<NEW_DATE:string,BC_1MONTH:double,BC_1YEAR:double>"


def yield_curve(payloads: DataFrame, text: str, tenor: str = "BC_1MONTH") -> DataFrame:
    """Daily par yields in XML entries to (date, rate as a fraction)."""
    entry = F.from_xml(F.col(text), YIELD_SCHEMA)
    return payloads.select(entry.alias("x")).select(
        F.to_date(F.substring("x.NEW_DATE", 1, 10)).alias("rate_date"),
        (F.col(f"x.{tenor}") / 100.0).alias("rate"),
    )


def read_yield_curve(spark: SparkSession, path: str, row_tag: str = "properties") -> DataFrame:
    schema = "NEW_DATE string, BC_1MONTH double, BC_1YEAR double"
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
