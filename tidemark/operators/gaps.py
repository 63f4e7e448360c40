"""Gaps between consecutive trades of sliding windows, from one mergeable summary per pane.

Most trades become visible at the end of the pane they were executed in, so every window over that
pane holds them.  Their distinct times reduce to a summary per pane (first, last, sum of squared
gaps); summaries of neighbouring panes merge by adding the squared gap between them.  Trades that
become visible earlier or later are kept apart: each finds its neighbours among the others, and the
windows that hold it are corrected by the gap it splits.  Only summaries and those trades are
spread over windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MICROS
from .panes import spread


def _square(later: Column, earlier: Column) -> Column:
    s = (later - earlier) / float(MICROS)
    return F.coalesce(s * s, F.lit(0.0))


def window_gap_squares(rows: DataFrame, keys: list[str], time_us: str, panes: int) -> DataFrame:
    """Sum of squared gaps (seconds) between distinct times per (keys, k), windows closed at the cutoff.

    ``rows`` carries exec_pane and seen_pane.  Equal times collapse; a window of one time has 0, one
    without rows has no record, and rows that no window holds or whose clocks are null do not count.
    A sort covers one pane of a key, or the apart trades between two others in one window.
    """
    pane = [*keys, "exec_pane"]
    held = rows.where(F.col("seen_pane") <= F.col("exec_pane") + panes)
    times = held.groupBy(*pane, "seen_pane", F.col(time_us).alias("_t")).agg(F.lit(1).alias("_1")).drop("_1").withColumn(
        "_plain", F.col("seen_pane") == F.col("exec_pane") + 1)
    plain = F.when(F.col("_plain"), F.col("_t"))
    so_far = (Window.unboundedPreceding, -1)
    before = Window.partitionBy(*pane).orderBy("_t", F.desc("_plain")).rowsBetween(*so_far)
    after = Window.partitionBy(*pane).orderBy(F.desc("_t"), "_plain").rowsBetween(*so_far)
    times = times.withColumns({"_a": F.last(plain, ignorenulls=True).over(before), "_b": F.last(plain, ignorenulls=True).over(after)})

    summary = times.where("_plain").groupBy(*pane).agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.sum(_square(F.col("_t"), F.col("_a"))).alias("_sq"))
    summary = summary.withColumn("seen_pane", F.col("exec_pane") + 1)
    merged = spread(summary, panes, False).groupBy(*keys, "k").agg(
        F.sum("_sq").alias("_sq"), F.sort_array(F.collect_list(F.struct("exec_pane", "_first", "_last"))).alias("_panes"))
    n = F.size("_panes")
    bridges = F.zip_with(F.slice("_panes", F.lit(1), n - 1), F.slice("_panes", F.lit(2), n - 1), lambda p, q: _square(q["_first"], p["_last"]))
    merged = merged.withColumn("_sq", F.col("_sq") + F.aggregate(bridges, F.lit(0.0), lambda acc, x: acc + x))

    apart = spread(times.where(~F.col("_plain")), panes, False).groupBy(*keys, "k", "exec_pane", "_t").agg(
        F.first("_a").alias("_a"), F.first("_b").alias("_b")).join(merged.select(*keys, "k", "_panes"), [*keys, "k"], "left")
    inside = F.col("exec_pane") < F.col("k")
    earlier = F.filter("_panes", lambda p: p["exec_pane"] < F.col("exec_pane"))
    later = F.filter("_panes", lambda p: p["exec_pane"] > F.col("exec_pane"))
    apart = apart.select(
        *keys, "k", "_t",
        F.coalesce(F.when(inside, F.col("_a")), F.get(earlier, F.size(earlier) - 1)["_last"]).alias("_a"),
        F.coalesce(F.when(inside, F.col("_b")), F.get(later, F.lit(0))["_first"]).alias("_b"))
    gap = Window.partitionBy(*keys, "k", "_a").orderBy("_t")
    apart = apart.withColumns({"_p": F.lag("_t").over(gap), "_q": F.lead("_t").over(gap)})
    first, last = F.col("_p").isNull(), F.col("_q").isNull()
    change = (
        _square(F.col("_t"), F.coalesce("_p", "_a")) + F.when(last, _square(F.col("_b"), F.col("_t"))).otherwise(0.0)
        - F.when(first, _square(F.col("_b"), F.col("_a"))).otherwise(0.0))
    both = merged.select(*keys, "k", "_sq").unionByName(apart.select(*keys, "k", change.alias("_sq")))
    return both.groupBy(*keys, "k").agg(F.sum("_sq").alias("gap_squares"))
