"""Ranks over unbounded groups: average ranks, AUC, Spearman, Kendall, deciles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import split_running_sum
from .quantiles import _ordered_bin


def _value_ranks(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Average and first rank of each distinct value from rows (keys, _v, _c)."""
    binned = counted.withColumn("_bin", _ordered_bin(F.col("_v")))
    run = split_running_sum(binned, keys, ["_v"], F.col("_bin"), F.col("_c"), "_upto")
    return run.withColumn("_rank", F.col("_upto") - (F.col("_c") - 1) / 2.0).drop("_bin")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows with the average rank of ``value`` in their key; only distinct values are ordered."""
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranks = _value_ranks(counted, keys).select(*keys, F.col("_v").alias(value), F.col("_rank").alias(name))
    return df.join(ranks, [*keys, value])


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Rank-sum AUC with tied scores sharing their average rank."""
    counted = df.groupBy(*keys, F.col(score).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    s = _value_ranks(counted, keys).groupBy(*keys).agg(
        F.sum("_pos").alias("positives"), F.sum(F.col("_c") - F.col("_pos")).alias("negatives"),
        F.sum(F.col("_pos") * F.col("_rank")).alias("_s"))
    p, n = F.col("positives"), F.col("negatives")
    return s.select(*keys, "positives", "negatives",
                    F.when((p > 0) & (n > 0), (F.col("_s") - p * (p + 1) / 2.0) / (p * n)).alias("auc"))


def tail_labels(df: DataFrame, keys: list[str], value: str, training: str, prob: float) -> DataFrame:
    """Flag values above the training quantile of their own key."""
    from .quantiles import group_quantiles

    cut = group_quantiles(df.where(F.col(training)), keys, value, {"threshold": prob})
    return df.join(cut, keys).withColumn("tail", F.col(value) > F.col("threshold"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    pairs = df.select(*keys, x, y)
    ranked = average_ranks(average_ranks(pairs, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"))


def deciles(df: DataFrame, keys: list[str], by: str, tie: str, value: str, parts: int = 10) -> DataFrame:
    """Mean of ``value`` per equal-count bucket ordered by (by, tie); larger buckets first."""
    pos = split_running_sum(df.select(*keys, by, tie, value), keys, [by, tie], _ordered_bin(F.col(by)), F.lit(1), "_pos")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    small = F.floor(F.col("_n") / parts)
    big = F.col("_n") % parts
    i = F.col("_pos") - 1
    head = big * (small + 1)
    bucket = F.when(i < head, F.floor(i / (small + 1))).otherwise(big + F.floor((i - head) / small))
    return pos.join(n, keys).withColumn("bucket", bucket.cast("bigint") + 1).groupBy(*keys, "bucket").agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("rows"))


def kendall(df: DataFrame, keys: list[str], x: str, y: str, tie: str) -> DataFrame:
    """Kendall tau-b without forming pairs.

    Rows are put in (x, y) order; a discordant pair is an inversion of y.  Inversions are
    counted bit by bit of the dense y rank: two ranks first differ at one bit, and at that bit
    an inversion is a one in front of a zero within equal higher bits.  Each row is counted once
    per bit, so the work is n log n and every running count is split into position buckets.
    """
    rows = df.select(*keys, x, y, tie)
    ys = rows.groupBy(*keys, F.col(y).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dense = split_running_sum(
        ys.withColumn("_bin", _ordered_bin(F.col("_v"))), keys, ["_v"], F.col("_bin"), F.lit(1), "_d"
    ).select(*keys, F.col("_v").alias(y), (F.col("_d") - 1).cast("bigint").alias("_d"))
    placed = split_running_sum(
        rows.join(dense, [*keys, y]), keys, [x, y, tie], _ordered_bin(F.col(x)), F.lit(1), "_pos")
    bits = dense.groupBy(*keys).agg(F.greatest(F.ceil(F.log2(F.max("_d") + 1.0)), F.lit(1)).cast("int").alias("_bits"))
    leveled = placed.join(bits, keys).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    leveled = leveled.withColumn("_one", F.expr("shiftright(_d, _b) & 1")).withColumn(
        "_prefix", F.expr("shiftright(_d, _b + 1)")).select(*keys, "_b", "_prefix", "_one", "_pos")
    ones = split_running_sum(
        leveled, [*keys, "_b", "_prefix"], ["_pos"], F.floor(F.col("_pos") / 65536), F.col("_one"), "_before")
    inv = ones.groupBy(*keys).agg(F.sum(F.when(F.col("_one") == 0, F.col("_before")).otherwise(0)).alias("_q"))

    def tied(cols: list[str], name: str) -> DataFrame:
        c = rows.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_c"))
        return c.groupBy(*keys).agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2.0).alias(name))

    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    j = n.join(inv, keys).join(tied([x], "_n1"), keys).join(tied([y], "_n2"), keys).join(tied([x, y], "_n3"), keys)
    n0 = F.col("n") * (F.col("n") - 1) / 2.0
    num = n0 - F.col("_n1") - F.col("_n2") + F.col("_n3") - 2.0 * F.col("_q")
    return j.select(*keys, "n", (num / F.sqrt((n0 - F.col("_n1")) * (n0 - F.col("_n2")))).alias("kendall_tau"))


