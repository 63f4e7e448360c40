"""Exact quantiles of unbounded groups, and mergeable log histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_DECADE = 200
LOWEST_DECADE = -4
HIGHEST_DECADE = 7


def _ordered_bin(v: Column, per_octave: int = 256) -> Column:
    """A whole number non-decreasing in ``v``: bins per octave of magnitude, signed; infinities at the ends, NaN last."""
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * float(per_octave)) + F.lit(300_000)
    inf = float("inf")
    ends = F.when(v == 0, F.lit(0)).when(F.isnan(v), F.lit(1_000_002)).when(v == inf, F.lit(1_000_001)).when(v == -inf, F.lit(-1_000_001))
    return ends.otherwise(F.signum(v).cast("bigint") * size)


def group_quantiles(
    df: DataFrame, keys: list[str], value: str | Column, probs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per key, exact, with no group held in one task.

    Rows are first counted per (key, value), which combines map-side.  Counts are summed into
    ordered bins; a running sum over the bins of a key finds the bins that hold the wanted
    ranks, and only the values of those bins are ordered.  ``percentile`` by contrast keeps all
    distinct values of a group in one buffer.  Keys must not be null.
    """
    v = F.col(value) if isinstance(value, str) else value
    values = (
        df.select(*keys, v.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return quantiles_of_counts(values, keys, probs)


def quantiles_of_counts(values: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """The second half of :func:`group_quantiles`, for rows (keys, _v, _c) already counted."""
    values = values.withColumn("_bin", _ordered_bin(F.col("_v")))
    bins = _wanted_bins(values.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_n")), keys, probs)
    return _at_ranks(values.join(bins, [*keys, "_bin"]), keys, probs)


def window_quantiles(
    rows: DataFrame, cell: list[str], keys: list[str], widen: Callable[[DataFrame], DataFrame], value: Column, probs: Mapping[str, float],
    per_octave: int = 16, few: int = 0,
) -> DataFrame:
    """Exact quantiles of overlapping windows, without a row per (row, window).

    Rows of one ``cell`` enter the same windows; ``widen`` turns rows with the cell's columns into
    rows with the windows' ``keys``.  Counts per (cell, ordered bin) are widened and show which bins of
    a window hold the wanted ranks.  Rows then meet the windows of their cell only in those bins.
    Rows without a value do not count.  Up to ``few`` opened bins, counted, are broadcast.
    """
    from ..sources.results import materialise

    binned = rows.select(*cell, value.cast("double").alias("_v")).where(F.col("_v").isNotNull()).withColumn(
        "_bin", _ordered_bin(F.col("_v"), per_octave))
    wide = widen(binned.groupBy(*cell, "_bin").agg(F.count(F.lit(1)).alias("_n")))
    bins = _wanted_bins(wide.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n")), keys, probs)
    opened = wide.select(*dict.fromkeys((*cell, *keys, "_bin"))).join(bins, [*keys, "_bin"])
    if few:
        opened = materialise(opened)
        opened = F.broadcast(opened) if opened.count() <= few else opened
    values = binned.join(opened, [*cell, "_bin"]).groupBy(*keys, "_bin", "_v", "_lo", "_total").agg(F.count(F.lit(1)).alias("_c"))
    return _at_ranks(values, keys, probs)


def _ranks(p: float) -> tuple[Column, Column, Column]:
    at = F.lit(float(p)) * (F.col("_total") - 1)
    low = F.floor(at)
    return low, F.ceil(at), at - low


def _holds(k: Column, lo: str, hi: str) -> Column:
    return (k >= F.col(lo)) & (k < F.col(hi))


def _wanted_bins(bins: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Of rows (keys, _bin, _n) those that hold a wanted rank: (keys, _bin, _lo, _total)."""
    part = Window.partitionBy(*keys)
    placed = (
        bins.withColumn(
            "_hi",
            F.sum("_n").over(part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(part))
    )
    wanted = F.lit(False)
    for p in probs.values():
        low, high, _ = _ranks(p)
        wanted = wanted | _holds(low, "_lo", "_hi") | _holds(high, "_lo", "_hi")
    return placed.where(wanted).drop("_n", "_hi")


def _at_ranks(values: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from the counted values (keys, _bin, _v, _c, _lo, _total) of the wanted bins."""
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    placed = values.withColumn(
        "_upto",
        F.col("_lo") + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    ).withColumn("_from", F.col("_upto") - F.col("_c"))
    aggs = []
    for name, p in probs.items():
        low, high, frac = _ranks(p)
        at_low = F.max(F.when(_holds(low, "_from", "_upto"), F.col("_v")))
        at_high = F.max(F.when(_holds(high, "_from", "_upto"), F.col("_v")))
        aggs.append(F.when(at_low == at_high, at_low).otherwise(at_low + (at_high - at_low) * F.max(frac)).alias(name))
    if not keys:
        return placed.agg(*aggs)
    return placed.groupBy(*keys).agg(*aggs)


def log_bin(seconds: Column) -> Column:
    """Bin of a positive latency: 200 per decade from 1e-4 to 1e7 seconds; null outside."""
    b = F.floor((F.log10(seconds) - LOWEST_DECADE) * BINS_PER_DECADE)
    top = (HIGHEST_DECADE - LOWEST_DECADE) * BINS_PER_DECADE
    return F.when((seconds > 0) & (b >= 0) & (b < top), b.cast("bigint"))


def latency_histogram(df: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """Additive histogram rows (keys, bin, n); merging two is a sum by bin."""
    return (
        df.select(*keys, log_bin(seconds).alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram_quantile(hist: DataFrame, keys: list[str], prob: float, name: str) -> DataFrame:
    """Quantile read off a histogram, log-linear inside the first bin that reaches it."""
    part = Window.partitionBy(*keys)
    running = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.sum("n").over(running)).withColumn(
        "_target", F.lit(prob) * F.sum("n").over(part)
    )
    low = F.col("bin") / float(BINS_PER_DECADE) + float(LOWEST_DECADE)
    frac = (F.col("_target") - (F.col("_cum") - F.col("n"))) / F.col("n")
    est = F.pow(F.lit(10.0), low + frac / float(BINS_PER_DECADE))
    return (
        cum.where(F.col("_cum") >= F.col("_target"))
        .groupBy(*keys)
        .agg(F.min_by(est, F.col("bin")).alias(name))
    )
