"""Structured Streaming windows under the two clocks.

Every function takes a streaming or a batch DataFrame with ``executed_at`` and ``created_at``
timestamps.  Point-in-time eligibility is a row predicate against the window end, which does not
depend on how rows arrive in batches; the watermark only says when a window is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trade_direction


def event_times(tape: DataFrame) -> DataFrame:
    return tape.withColumn("executed_at", F.timestamp_micros("executed_us")).withColumn(
        "created_at", F.timestamp_micros("created_us"))


def _eligible(tape: DataFrame, window: Column, delay: str) -> DataFrame:
    w = tape.withWatermark("executed_at", delay).withColumn("w", window)
    return w.where(F.col("created_at") <= F.col("w.end"))


def tumbling_activity(tape: DataFrame, length: str, delay: str) -> DataFrame:
    """Counts and premium per asset and window of rows on record by the window end."""
    return _eligible(tape, F.window("executed_at", length), delay).groupBy("w", "asset").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("premium").alias("premium"), F.max("premium").alias("max_premium"))


def sliding_flow(tape: DataFrame, length: str, slide: str, delay: str) -> DataFrame:
    """Signed premium over overlapping windows."""
    signed = F.col("premium") * trade_direction(F.col("tags"))
    w = tape.withColumn("signed", signed).withWatermark("executed_at", delay)
    eligible = w.select("*", F.window("executed_at", length, slide).alias("w")).where(F.col("created_at") <= F.col("w.end"))
    return eligible.groupBy("w", "asset").agg(F.count(F.lit(1)).alias("trades"), F.sum("signed").alias("signed_premium"))


def first_receipts(receipts: DataFrame, delay: str) -> DataFrame:
    """The earliest receipt of each record, whichever of its receipts arrives first.

    Receipts of a record less than ``delay`` apart form one run, whose state is its smallest time
    and its count; a run is emitted once the watermark has passed its end, and its state ends.
    """
    w = receipts.withWatermark("received_at", delay)
    return w.groupBy(F.session_window("received_at", delay).alias("w"), "record_id").agg(
        F.min("received_at").alias("first_received_at"), F.count(F.lit(1)).alias("receipts"))


def reconcile(receipts: DataFrame, tape: DataFrame, bound: str, delay: str) -> DataFrame:
    """Receipts joined to tape rows on their fingerprint within a time bound."""
    r = receipts.withWatermark("received_at", delay).select(F.col("fp").alias("r_fp"), "received_at")
    t = tape.withWatermark("created_at", delay)
    return t.join(r, F.expr(f"fp = r_fp AND received_at >= created_at AND received_at <= created_at + INTERVAL {bound}")).drop("r_fp")


def heartbeats(tape: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of activity per asset; a silence longer than ``gap`` ends a run, which is the alert."""
    w = tape.withWatermark("executed_at", delay)
    return w.groupBy(F.session_window("executed_at", gap).alias("w"), "asset").agg(F.count(F.lit(1)).alias("trades"))
