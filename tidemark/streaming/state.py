"""Keyed state that Spark's built-in aggregates do not express."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "asset string, contract bigint, created_us bigint, id bigint, iv double, bid double, ask double"
DECAY = "asset string, salt bigint, last_us bigint, intensity double"


def latest_per_contract(tape: DataFrame, delay: str = "10 minutes", ttl_ms: int = 1_800_000) -> DataFrame:
    """The newest record of each contract, dropped from state ``ttl_ms`` of event time later.

    Emits the current record of every contract that a batch touches (update mode).  State is one
    row per contract; a batch is read as a stream of Arrow chunks, never as a whole.
    """
    names = [f.split()[0] for f in LATEST.split(", ")]

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for pdf in chunks:
            row = pdf.sort_values(["created_us", "id"]).iloc[-1]
            seen = (int(row["created_us"]), int(row["id"]), float(row["iv"]), float(row["bid"]), float(row["ask"]))
            best = seen if best is None or seen[:2] > tuple(best[:2]) else best
        if best is not None:
            state.update(tuple(best))
            state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + ttl_ms)
            yield pd.DataFrame([[*key, *best]], columns=names)

    timed = tape.withWatermark("created_at", delay).select(*names, "created_at")
    return timed.groupBy("asset", "contract").applyInPandasWithState(
        step, LATEST, "created_us bigint, id bigint, iv double, bid double, ask double", "update",
        GroupStateTimeout.EventTimeTimeout)


def decay_intensity(tape: DataFrame, decay_s: float, salts: int = 16) -> DataFrame:
    """Exponentially decayed activity per asset as keyed state.

    The state is a time and a level; levels of several salts add after being aged to one time,
    so a busy asset is spread over ``salts`` keys and :func:`combine_decay` adds them up.
    """
    rate = 1.0 / (decay_s * 1e6)
    names = [f.split()[0] for f in DECAY.split(", ")]

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, level = state.get if state.exists else (None, 0.0)
        for pdf in chunks:
            top = int(pdf["executed_us"].max())
            now = top if last is None else max(last, top)
            if last is not None:
                level *= math.exp(-(now - last) * rate)
            ages = (now - pdf["executed_us"].to_numpy(dtype="int64")) * rate
            level += float(pd.Series(-ages).map(math.exp).sum())
            last = now
        if last is not None:
            state.update((last, level))
            yield pd.DataFrame([[*key, last, level]], columns=names)

    salted = tape.select("asset", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "executed_us")
    return salted.groupBy("asset", "salt").applyInPandasWithState(
        step, DECAY, "last_us bigint, level double", "update", GroupStateTimeout.NoTimeout)


def combine_decay(states: DataFrame, decay_s: float) -> DataFrame:
    """One level per asset at its latest event, from the newest state of every salt."""
    new = states.groupBy("asset", "salt").agg(F.max_by(F.struct("last_us", "intensity"), "last_us").alias("_s")).select("asset", "_s.*")
    top = new.groupBy("asset").agg(F.max("last_us").alias("at_us"))
    aged = F.col("intensity") * F.exp(-(F.col("at_us") - F.col("last_us")) / (decay_s * 1e6))
    return new.join(top, "asset").groupBy("asset", "at_us").agg(F.sum(aged).alias("intensity"))
