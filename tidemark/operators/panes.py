"""Trades to forecast windows without a range join.

Origins sit on a fixed step.  With the cutoff delay added, an execution falls into one pane and
a record becomes visible at one pane boundary, so the windows that hold a trade are a run of
consecutive origins known from two integers.  Additive measures are first summed per
(key, execution pane, visibility pane): one cell takes all trades of that pane, partial sums
combine map-side, and only cells, not trades, are spread over the windows.  A hot name costs
its number of cells, not its number of trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS, ceil_div, floor_div


def with_panes(tape: DataFrame, step_us: int, delay_s: int | Column = 0) -> DataFrame:
    """Add the execution pane and the first origin index at which the record is visible."""
    d = delay_s * F.lit(MICROS).cast("bigint") if isinstance(delay_s, Column) else F.lit(delay_s * MICROS)
    return tape.withColumn("exec_pane", floor_div(F.col("executed_us") + d, step_us)).withColumn(
        "seen_pane", ceil_div(F.col("created_us") + d, step_us)
    )


def spread(cells: DataFrame, panes: int, open_end: bool) -> DataFrame:
    """One row per cell and origin index ``k`` whose window holds it.

    ``open_end`` gives windows [start, end) on execution; otherwise the window is closed at the
    cutoff and only visibility bounds it from above.
    """
    first = F.greatest("seen_pane", F.col("exec_pane") + 1) if open_end else F.col("seen_pane")
    last = F.col("exec_pane") + panes
    return cells.where(F.col("seen_pane").isNotNull() & (first <= last)).withColumn("k", F.explode(F.sequence(first, last)))


def cells(tape: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return tape.groupBy(*keys, "exec_pane", "seen_pane").agg(*aggs)


def origin_index(origins: DataFrame, step_us: int) -> DataFrame:
    """Origins with their index ``k``; origins must sit on the step."""
    return origins.withColumn("k", floor_div(F.col("origin_us"), step_us))


def window_rows(
    tape: DataFrame, origins: DataFrame, step_us: int, panes: int, delay_s: int, open_end: bool
) -> DataFrame:
    """Trade rows joined to every origin whose window holds them, for per-row measures."""
    rows = spread(with_panes(tape, step_us, delay_s), panes, open_end).drop("exec_pane", "seen_pane")
    keyed = origin_index(origins, step_us).select("asset", "k", "origin_id", "origin_us")
    return rows.join(keyed, ["asset", "k"])
