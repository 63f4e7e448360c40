"""Row features of origins and trades that are not window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ceil_div, floor_div, floored, with_scalars
from .grid import origin_grid
from .ordered import split_lag
from .quantiles import group_quantiles

HOUR_US = 3_600_000_000


def sized_origins(
    calendar: DataFrame, bars: DataFrame, assets: list[str], edge: int, step: int, horizon: int,
    bar_minutes: int,
) -> DataFrame:
    """Origins edge .. length-edge (exclusive), from the asset's first bar plus a horizon on."""
    first = bars.groupBy("asset", "session_date").agg(
        (F.min("bar") * bar_minutes).alias("first_minute")
    )
    grid = origin_grid(calendar, assets, edge, edge, step, inclusive=False)
    return (
        grid.join(first, ["asset", "session_date"])
        .where(F.col("minute") >= F.col("first_minute") + horizon)
        .select("asset", "session_date", "minute")
    )


def event_presence(origins: DataFrame, events: DataFrame, step_us: int, panes: int) -> DataFrame:
    """Whether any event falls in (origin - window, origin]; events reduce to panes first."""
    seen = (
        events.select("asset", ceil_div(F.col("executed_us"), step_us).alias("p"))
        .distinct()
        .select("asset", F.explode(F.sequence("p", F.col("p") + (panes - 1))).alias("k"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    keyed = origins.withColumn("k", floor_div(F.col("origin_us"), step_us))
    return keyed.join(seen, ["asset", "k"], "left").select(
        "origin_id", F.coalesce("_hit", F.lit(False)).alias("event_present")
    )


def multileg_size(tape: DataFrame, keys: tuple[str, ...] = ("asset", "contract")) -> DataFrame:
    """Increase of the running multi-leg total since the contract's last print, in [0, size]."""
    return lagged_trades(tape, keys).drop("d_iv", "d_mid_rel", "d_spread", "has_previous", "mid", "rel_spread")


def lagged_trades(tape: DataFrame, keys: tuple[str, ...] = ("asset", "contract")) -> DataFrame:
    """Multi-leg size and the changes from the contract's previous print, from one lag."""
    mid = (F.col("bid") + F.col("ask")) / 2.0
    t = tape.withColumn("mid", mid).withColumn(
        "rel_spread", (F.col("ask") - F.col("bid")) / floored("mid", 1e-9)
    )
    lagged = split_lag(
        t, list(keys), ["created_us", "id"], floor_div(F.col("created_us"), 6 * HOUR_US),
        ["multi_vol", "iv", "mid", "rel_spread"],
    )

    def diff(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    grown = diff(F.col("multi_vol") - F.col("prev_multi_vol"))
    return (
        lagged.withColumn("d_iv", diff(F.col("iv") - F.col("prev_iv")))
        .withColumn("d_mid_rel", diff((F.col("mid") - F.col("prev_mid")) / floored("prev_mid", 1e-9)))
        .withColumn("d_spread", diff(F.col("rel_spread") - F.col("prev_rel_spread")))
        .withColumn("multileg_size", F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), grown)))
        .withColumnRenamed("prev_exists", "has_previous")
        .drop("prev_multi_vol", "prev_iv", "prev_mid", "prev_rel_spread")
    )


def previous_trade_deltas(tape: DataFrame, keys: tuple[str, ...] = ("asset", "contract")) -> DataFrame:
    """Change of IV, relative mid and relative spread from the contract's previous print.

    A first print has zero changes and ``has_previous`` false.
    """
    return lagged_trades(tape, keys).drop("multileg_size")


def training_cutpoints(df: DataFrame, value: str, training: Column) -> DataFrame:
    """One row: the 1/3 and 2/3 quantiles over training rows only."""
    return group_quantiles(df.where(training), [], value, {"lower": 1 / 3, "upper": 2 / 3})


def regime(df: DataFrame, cuts: DataFrame, value: str) -> DataFrame:
    """LOW, MIDDLE or HIGH against frozen cutpoints (a one-row frame)."""
    return with_scalars(df, cuts).withColumn(
        "regime",
        F.when(F.col(value) <= F.col("lower"), "LOW")
        .when(F.col(value) <= F.col("upper"), "MIDDLE")
        .otherwise("HIGH"),
    ).drop("lower", "upper")


def canonicalise(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Fold alias columns into their canonical names; a row on which two disagree fails."""
    out = df
    for alias, name in aliases.items():
        if alias not in out.columns:
            continue
        if name not in out.columns:
            out = out.withColumnRenamed(alias, name)
            continue
        clash = F.col(alias).isNotNull() & F.col(name).isNotNull() & (F.col(alias) != F.col(name))
        value = F.when(clash, F.raise_error(F.lit(f"alias conflict: {alias}")).cast("double")).otherwise(
            F.coalesce(name, alias)
        )
        out = out.withColumn(name, value).drop(alias)
    return out.withColumn("conflicts", F.lit(0).cast("bigint"))


def swap_variant(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """Take the timing variant ``<column>_<suffix>`` under the canonical column name."""
    missing = [c for c in columns if f"{c}_{suffix}" not in df.columns]
    if missing:
        raise ValueError(f"variant columns missing: {','.join(missing)}")
    return df.withColumns({c: F.col(f"{c}_{suffix}") for c in columns}).drop(
        *[f"{c}_{suffix}" for c in columns]
    )
