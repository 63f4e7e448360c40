"""Ordered operators whose groups may be huge: lag, last value and running sum.

``lag over (partition by key order by t)`` puts every row of one key in one task.  With a key
that holds a third of the data that task never ends.  The helpers here cut a key into time
buckets, do the ordered work inside (key, bucket), reduce each bucket to one summary row, run
the window over the summaries (one row per bucket) and join the carried value back.  Results
equal the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_lag(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    values: list[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add the previous row's ``values`` within ``keys`` by ``order``; ``prev_exists`` flags it.

    ``bucket`` must be non-decreasing in the first order column.
    """
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    tagged = df.withColumn("_bucket", bucket)
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    inner = tagged.withColumn("_prev", F.lag(payload).over(w))
    tails = tagged.groupBy(*keys, "_bucket").agg(
        F.max_by(payload, F.struct(*order)).alias("_tail")
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    carried = tails.withColumn("_carry", F.lag("_tail").over(by_bucket)).drop("_tail")
    joined = inner.join(carried, [*keys, "_bucket"], "left").withColumn(
        "_prev", F.coalesce("_prev", "_carry")
    )
    return joined.select(
        *df.columns,
        *[F.col(f"_prev.{v}").alias(f"{prefix}{v}") for v in values],
        F.col("_prev").isNotNull().alias(f"{prefix}exists"),
    )


def split_running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` by ``order``."""
    tagged = df.withColumn("_bucket", bucket).withColumn("_running", value)
    w = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_running").alias("_total"))
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    return (
        tagged.withColumn("_run", F.sum("_running").over(w))
        .join(base.drop("_total"), [*keys, "_bucket"])
        .select(*df.columns, (F.col("_run") + F.col("_base")).alias(name))
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    right_columns: list[str],
    bucket_width: int,
    tie: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Left rows with the last right row of the same key at or before (``strict``: before) them.

    Times are bigints.  The right side is reduced to one row per (key, time) first, the last by
    ``tie``; both sides are then merged inside (key, time bucket) and each bucket's last right
    row is carried forward, so a hot key spreads over its buckets.
    """
    tie = tie or []
    value = F.struct(
        F.col(right_time).alias(right_time),
        *[F.col(c).alias(c) for c in right_columns if c != right_time],
    )
    last_at = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.max_by(value, F.struct(*(tie or [right_time]))).alias("_right")
    )
    payload = [c for c in left.columns if c not in keys]
    left_rows = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(0 if strict else 1).alias("_side"),
        F.struct(*payload).alias("_left"),
    )
    right_rows = last_at.select(*keys, "_t", F.lit(0 if not strict else 1).alias("_side"), "_right")
    merged = left_rows.unionByName(right_rows, allowMissingColumns=True).withColumn(
        "_bucket", (F.col("_t") - F.pmod(F.col("_t"), F.lit(bucket_width).cast("bigint")))
    )
    w = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inner = merged.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where(
        F.col("_left").isNotNull()
    )
    tails = merged.groupBy(*keys, "_bucket").agg(
        F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_t"))).alias("_tail")
    )
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before)).drop(
        "_tail"
    )
    kept = [c for c in dict.fromkeys([right_time, *right_columns])]
    return (
        inner.join(carried, [*keys, "_bucket"], "left")
        .withColumn("_hit", F.coalesce("_hit", "_carry"))
        .select(
            *keys,
            *[F.col(f"_left.{c}").alias(c) for c in payload],
            *[F.col(f"_hit.{c}").alias(c) for c in kept],
        )
        .select(*left.columns, *kept)
    )


def split_running_max(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Inclusive running maximum of ``value`` within ``keys`` by ``order``."""
    tagged = df.withColumn("_bucket", bucket).withColumn("_running", value)
    upto = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tops = tagged.groupBy(*keys, "_bucket").agg(F.max("_running").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select(*keys, "_bucket", F.max("_top").over(before).alias("_base"))
    return (
        tagged.withColumn("_run", F.max("_running").over(upto))
        .join(base, [*keys, "_bucket"])
        .select(*df.columns, F.greatest("_run", "_base").alias(name))
    )
