"""Point-in-time joins: last quote, snapshots, pairing, reconciliation, masks and bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MICROS, ceil_div, floor_div
from .ordered import asof_join

DAY_BUCKET = 86_400 * MICROS


def attach(origins: DataFrame, features: list[DataFrame], key: str) -> DataFrame:
    """Left joins on the origin key; only new columns come in and every origin stays."""
    out = origins
    for f in features:
        new = [key] + [c for c in f.columns if c not in out.columns]
        out = out.join(f.select(*new), key, "left")
    return out


def deduplicate_sources(bars: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One source per session-asset, the first by name; overlapping prices must agree.

    A disagreement fails the job at the group that shows it.
    """
    keys = ["asset", "session_date", "bar"]
    spread = F.max("close") - F.min("close")
    chosen = (
        bars.groupBy(*keys)
        .agg(spread.alias("_gap"), F.min("source").alias("_first"))
        .groupBy("asset", "session_date")
        .agg(F.max("_gap").alias("_gap"), F.min("_first").alias("source"))
        .where(
            F.when(
                F.col("_gap") > tolerance, F.raise_error(F.lit("bar sources disagree")).cast("boolean")
            ).otherwise(True)
        )
    )
    return bars.join(chosen.drop("_gap"), ["asset", "session_date", "source"], "left_semi")


def key_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and unexpected keys, one row each."""
    missing = expected.select(*keys).distinct().join(actual, keys, "left_anti")
    extra = actual.select(*keys).distinct().join(expected, keys, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(
        extra.withColumn("side", F.lit("unexpected"))
    )


def key_sets_differ(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that are not in every frame exactly once; empty when the key sets are identical."""
    tagged = [f.select(*keys, F.lit(i).alias("_i")) for i, f in enumerate(frames)]
    n = len(frames)
    return (
        reduce(lambda a, b: a.unionByName(b), tagged)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("_i").alias("frames"))
        .where((F.col("copies") != n) | (F.col("frames") != n))
    )


def full_outer_controls(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Columns of several control assets side by side on coalesced keys."""
    renamed = [
        f.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in f.columns if c not in keys])
        for name, f in frames.items()
    ]
    return reduce(lambda a, b: a.join(b, keys, "full"), renamed)


def inclusion_grid(grid: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    seen = observed.select(*keys).distinct().withColumn("included", F.lit(True))
    return grid.join(seen, keys, "left").withColumn(
        "included", F.coalesce("included", F.lit(False))
    )


def last_quote(
    origins: DataFrame, quotes: DataFrame, keys: list[str], cutoff_s: int, columns: list[str]
) -> DataFrame:
    """The last quote at or before origin - cutoff, valid or not: no walking back.

    Of quotes at one time the one with the largest ``id`` (their sequence) is the last.
    """
    left = origins.withColumn("cutoff_us", F.col("origin_us") - F.lit(cutoff_s * MICROS))
    return asof_join(
        left, quotes, keys, "cutoff_us", "quote_us", columns, DAY_BUCKET // 4, ["quote_us", "id"]
    )


def contract_snapshot(
    tape: DataFrame, step_us: int, panes: int, cutoff_s: int, values: list[str]
) -> DataFrame:
    """Latest record per (asset, origin index, contract) inside [cutoff - window, cutoff].

    Both ends are closed and age counts from the origin.  Records first reduce to the last one
    of each contract and pane; a record exactly on a pane boundary also belongs to the window
    that starts there, so boundary records are counted apart.
    """
    d = F.lit(cutoff_s * MICROS)
    row = F.struct("created_us", "id", *[v for v in values if v not in ("created_us", "id")])
    shifted = F.col("created_us") + d
    per_pane = (
        tape.withColumn("_p", ceil_div(shifted, step_us))
        .groupBy("asset", "contract", "_p")
        .agg(
            F.max_by(row, F.struct("created_us", "id")).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.pmod(shifted, F.lit(step_us).cast("bigint")) == 0).alias("_edge"),
        )
    )
    last_k = F.col("_p") + F.when(F.col("_edge") > 0, panes).otherwise(panes - 1)
    at_edge = F.col("k") == F.col("_p") + panes
    return (
        per_pane.withColumn("k", F.explode(F.sequence("_p", last_k)))
        .withColumn("_m", F.when(at_edge, F.col("_edge")).otherwise(F.col("_n")))
        .groupBy("asset", "k", "contract")
        .agg(
            F.max_by("_last", F.struct("_last.created_us", "_last.id")).alias("_last"),
            F.sum("_m").alias("records"),
        )
        .select("asset", "k", "contract", "_last.*", "records")
        .withColumn("origin_us", F.col("k") * F.lit(step_us))
        .withColumn("quote_age_s", (F.col("origin_us") - F.col("created_us")) / float(MICROS))
    )


def trailing_sum(rows: DataFrame, at_us: Column, step_us: int, panes: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over rows of the same session in [origin - window, origin), by origin index.

    Rows reduce to one cell per (asset, session, pane) before cells are spread over origins.
    """
    cells = rows.withColumn("_p", floor_div(at_us, step_us)).groupBy("asset", "session_date", "_p").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    return (
        cells.withColumn("k", F.explode(F.sequence(F.col("_p") + 1, F.col("_p") + panes)))
        .groupBy("asset", "session_date", "k")
        .agg(*[F.sum(n).alias(n) for n in sums])
    )


def exact_lag(df: DataFrame, keys: list[str], time: str, lag: int, values: list[str], suffix: str) -> DataFrame:
    """Value at exactly ``time - lag`` of the same key; null where that row does not exist."""
    past = df.select(
        *keys, (F.col(time) + F.lit(lag)).alias(time),
        *[F.col(v).alias(f"{v}_{suffix}") for v in values],
    )
    return df.join(past, [*keys, time], "left")


def co_strike_pairs(quotes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Call and put of the same strike and expiry side by side; a duplicated side fails."""
    aggs: list[Column] = []
    for side in ("call", "put"):
        is_side = F.col("option_type") == side
        aggs.append(F.count_if(is_side).alias(f"_n_{side}"))
        aggs += [F.max(F.when(is_side, F.col(v))).alias(f"{side}_{v}") for v in values]
    both = quotes.groupBy(*keys).agg(*aggs)
    dup = (F.col("_n_call") > 1) | (F.col("_n_put") > 1)
    return both.where(
        F.when(dup, F.raise_error(F.lit("duplicate side of a strike")).cast("boolean")).otherwise(
            (F.col("_n_call") == 1) & (F.col("_n_put") == 1)
        )
    ).drop("_n_call", "_n_put")


def reconcile_bars(a: DataFrame, b: DataFrame, keys: list[str], slot: str, shifts: dict[str, int]) -> DataFrame:
    """Two vendors' bars joined at each label shift, with the relative close difference."""
    shift = F.explode(
        F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("by")) for n, s in shifts.items()])
    )
    moved = a.withColumn("_s", shift).select(
        "_s.label", *keys, (F.col(slot) + F.col("_s.by")).alias(slot), F.col("close").alias("close_a")
    )
    return moved.join(b.select(*keys, slot, F.col("close").alias("close_b")), [*keys, slot]).withColumn(
        "rel_diff", F.abs(F.col("close_a") - F.col("close_b")) / F.col("close_b")
    )


def fingerprint(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def reconcile_live(tape: DataFrame, live: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """Tape rows against live receipts on their fingerprint, summed per group.

    An unmatched tape row is an upper bound on backfill.  Live rows reduce to the first receipt
    of each fingerprint.
    """
    first = live.groupBy("fp").agg(
        F.min("received_us").alias("received_us"),
        *[F.min_by(c, "received_us").alias(f"live_{c}") for c in shared],
    )
    changed = reduce(lambda x, y: x | y, [F.col(c) != F.col(f"live_{c}") for c in shared])
    j = tape.join(first, "fp", "left")
    hit = F.col("received_us").isNotNull()
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tape_rows"),
        F.count_if(hit).alias("matched"),
        F.count_if(hit & changed).alias("revised"),
        (1.0 - F.count_if(hit) / F.count(F.lit(1))).alias("backfill_upper_bound"),
        F.avg((F.col("received_us") - F.col("created_us")) / float(MICROS)).alias("mean_latency_s"),
    )


def prior_reference(rows: DataFrame, reference: DataFrame, day: str, ref_day: str, values: list[str]) -> DataFrame:
    """The last reference row dated strictly before each row's day.

    Only the distinct days are matched (their number is bounded by the calendar), then joined
    back.
    """
    days = rows.select(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint").alias("_d"), day).distinct()
    ref = reference.withColumn("_r", F.datediff(ref_day, F.lit("1970-01-01").cast("date")).cast("bigint"))
    one = F.lit(0)
    hit = asof_join(
        days.withColumn("_k", one), ref.withColumn("_k", one), ["_k"], "_d", "_r",
        [ref_day, *values], 400, strict=True,
    ).drop("_k", "_d", "_r")
    return rows.join(hit, day, "left")


def trailing_days(daily: DataFrame, keys: list[str], day: str, days: int, value: str, name: str) -> DataFrame:
    """Sum over [day - days, day) of a per-day series; one row per key and day going in."""
    n = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
    w = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-days, -1)
    return daily.withColumn("_d", n).withColumn(name, F.sum(value).over(w)).drop("_d")


def availability_mask(df: DataFrame, sidecar: DataFrame, key: str, features: list[str], ok: str = "eligible") -> DataFrame:
    """Features of ineligible origins become null, never zero; an uncovered origin fails."""
    j = df.join(sidecar.select(key, ok), key, "left")
    flag = F.when(F.col(ok).isNull(), F.raise_error(F.lit("origin without availability")).cast("boolean")).otherwise(F.col(ok))
    return j.withColumns({f: F.when(flag, F.col(f)) for f in features})


def replace_columns(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The listed columns taken from a variant with the same keys; the rest is unchanged."""
    return df.drop(*columns).join(other.select(key, *columns), key, "left").select(*df.columns)


def eligible_events(origins: DataFrame, events: DataFrame, cutoff_s: int) -> DataFrame:
    """Per origin the number of usable events and the last one.

    Usable: same asset, event time at or before the origin, available at or before the cutoff,
    quality point_in_time.  Both bounds are one: the later of event time and availability plus
    cutoff must not exceed the origin.
    """
    usable = events.where(
        (F.col("quality") == "point_in_time") & F.col("available_us").isNotNull() & F.col("event_us").isNotNull()
    ).withColumn(
        "usable_us", F.greatest("event_us", F.col("available_us") + F.lit(cutoff_s * MICROS))
    )
    per_time = usable.groupBy("asset", "usable_us").agg(
        F.count(F.lit(1)).alias("_n"), F.max("event_us").alias("_last")
    )
    bucket = Window.partitionBy("asset", "_b").orderBy("usable_us")
    tagged = per_time.withColumn("_b", floor_div(F.col("usable_us"), DAY_BUCKET))
    base = tagged.groupBy("asset", "_b").agg(F.sum("_n").alias("_bn"), F.max("_last").alias("_bl"))
    before = Window.partitionBy("asset").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(
        "asset", "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_base"),
        F.max("_bl").over(before).alias("_bmax"),
    )
    run = tagged.join(base, ["asset", "_b"]).select(
        "asset", "usable_us", (F.sum("_n").over(bucket) + F.col("_base")).alias("events"),
        F.greatest(F.max("_last").over(bucket), "_bmax").alias("last_event_us"),
    )
    return asof_join(
        origins, run, ["asset"], "origin_us", "usable_us", ["events", "last_event_us"], DAY_BUCKET
    ).withColumn("events", F.coalesce("events", F.lit(0).cast("bigint"))).drop("usable_us")


def lineage_counts(origins: DataFrame, sources: dict[str, DataFrame], step_us: int, cutoff_s: int) -> DataFrame:
    """Records of each source on record by the cutoff, since the start of the session.

    Each source is reduced to counts per (asset, session, pane) before anything is ordered.
    """
    shift = F.lit(cutoff_s * MICROS)
    tagged = [
        df.select("asset", "session_date", ceil_div(F.col("created_us") + shift, step_us).alias("k"),
                  *[F.lit(int(n == name)).alias(n) for n in sources])
        .groupBy("asset", "session_date", "k").agg(*[F.sum(n).alias(n) for n in sources])
        for name, df in sources.items()
    ]
    o = origins.select("origin_id", "asset", "session_date", floor_div(F.col("origin_us"), step_us).alias("k"))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*tagged, o])
    w = Window.partitionBy("asset", "session_date").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    return both.select(
        "origin_id", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sources]
    ).where(F.col("origin_id").isNotNull())


def event_neighbourhood(rows: DataFrame, event_days: DataFrame, sessions: DataFrame, reach: int = 1) -> DataFrame:
    """Flag rows whose session is within ``reach`` sessions of an event session of the asset."""
    rank = sessions.select("session_date").distinct().withColumn(
        "_r", F.row_number().over(Window.orderBy("session_date"))
    )
    near = (
        event_days.select("asset", "session_date").distinct().join(rank, "session_date")
        .select("asset", F.explode(F.sequence(F.col("_r") - reach, F.col("_r") + reach)).alias("_r"))
        .distinct().join(rank, "_r").select("asset", "session_date", F.lit(True).alias("near_event"))
    )
    return rows.join(near, ["asset", "session_date"], "left").withColumn(
        "near_event", F.coalesce("near_event", F.lit(False))
    )


def paired_losses(base: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Base and expanded loss on identical keys; an unpaired row or a drifting target fails."""
    j = base.select(*keys, F.col("actual").alias("_a"), F.col("loss").alias("loss_base")).join(
        wide.select(*keys, F.col("actual").alias("_b"), F.col("loss").alias("loss_wide")), keys, "full"
    )
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") != F.col("_b"))
    return j.where(
        F.when(bad, F.raise_error(F.lit("unpaired loss")).cast("boolean")).otherwise(True)
    ).select(*keys, "loss_base", "loss_wide", (F.col("loss_base") - F.col("loss_wide")).alias("difference"))


def bind_targets(registered: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """Exactly one valid target per registered origin; anything else fails the job."""
    one = targets.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(target).alias(target))
    j = registered.join(one, key, "left")
    bad = F.coalesce(F.col("_n"), F.lit(0)) != 1
    bad = bad | F.col(target).isNull() | (F.col(target) <= 0)
    return j.where(
        F.when(bad, F.raise_error(F.lit("origin without one valid target")).cast("boolean")).otherwise(True)
    ).drop("_n")




def deduplicate_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Equal copies of an event collapse; two different events under one key fail the job."""
    rest = [c for c in events.columns if c not in keys]
    row = F.struct(*rest)
    return (
        events.groupBy(*keys)
        .agg(F.min(row).alias("_lo"), F.max(row).alias("_hi"))
        .where(
            F.when(~F.col("_lo").eqNullSafe(F.col("_hi")), F.raise_error(F.lit("conflicting events")).cast("boolean"))
            .otherwise(True)
        )
        .select(*keys, "_lo.*")
    )


def pristine_run(sessions: DataFrame, exposed: DataFrame, length: int) -> DataFrame:
    """The earliest run of at least ``length`` consecutive sessions with no exposure."""
    w = Window.orderBy("session_date")
    ranked = sessions.select("session_date").distinct().withColumn("_rn", F.row_number().over(w))
    clean = ranked.join(exposed.select("session_date").distinct(), "session_date", "left_anti")
    islands = clean.withColumn("_island", F.col("_rn") - F.row_number().over(w))
    return (
        islands.groupBy("_island")
        .agg(F.min("session_date").alias("start_date"), F.max("session_date").alias("end_date"),
             F.count(F.lit(1)).alias("sessions"))
        .where(F.col("sessions") >= length)
        .orderBy("start_date").limit(1).drop("_island")
    )
