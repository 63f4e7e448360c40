"""Data-quality gates: keys, schemas, coverage, completeness, purge, seals and audits.

Checks return DataFrames of findings so that a caller decides what fails; ``require_empty``
turns findings into an error by reading at most one row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS, finite, with_scalars


def require_empty(findings: DataFrame, code: str) -> None:
    row = findings.limit(1).collect()
    if row:
        raise ValueError(f"{code}: {row[0].asDict()}")


def quote_reason(age_max_s: float = 60.0, spread_max: float = 0.25) -> Column:
    """Why a quote attempt is unusable, or null; a quote from the future fails the job.

    Reads cutoff_us, quote_us, bid, ask, iv, expiry, session_date.
    """
    age = (F.col("cutoff_us") - F.col("quote_us")) / float(MICROS)
    mid = (F.col("bid") + F.col("ask")) / 2.0
    return (
        F.when(F.col("quote_us").isNull(), "NO_TIMESTAMP")
        .when(age < 0, F.raise_error(F.lit("quote after cutoff")))
        .when(age > age_max_s, "STALE")
        .when(
            finite("bid").isNull() | finite("ask").isNull() | (F.col("bid") <= 0)
            | (F.col("ask") <= F.col("bid")),
            "INVALID_SPREAD",
        )
        .when((F.col("ask") - F.col("bid")) / mid > spread_max, "WIDE_SPREAD")
        .when(finite("iv").isNull() | (F.col("iv") <= 0), "IV_INVALID")
        .when(F.col("expiry") <= F.col("session_date"), "EXPIRED")
    )


def is_available(executed: Column, created: Column, start: Column, end: Column) -> Column:
    """Executed in [start, end) and on record by end."""
    return (executed >= start) & (executed < end) & (executed <= end) & (created <= end)


def bar_available(bar_us: Column, origin: Column, delay_s: int) -> Column:
    return bar_us + F.lit(delay_s * MICROS) <= origin


def forbid_columns(df: DataFrame, forbidden: tuple[str, ...] = ("target", "rv30", "qlike")) -> None:
    """Refuse a frame that carries an outcome-like column."""
    bad = [
        c for c in df.columns
        if any(c.lower() == f or c.lower().startswith(f + "_") for f in forbidden)
    ]
    if bad:
        raise ValueError(f"outcome columns not allowed: {','.join(sorted(bad))}")


def strip_columns(df: DataFrame, forbidden: tuple[str, ...] = ("target", "rv30", "qlike")) -> DataFrame:
    return df.drop(
        *[c for c in df.columns
          if any(c.lower() == f or c.lower().startswith(f + "_") for f in forbidden)]
    )


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or occur more than once."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(
        (F.col("copies") > 1) | any_null
    )


def assert_unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    require_empty(key_violations(df, keys), "duplicate or null key")
    return df


def join_cardinality(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: left rows, joined rows, duplicated right keys, one_to_one flag."""
    n_left = left.agg(F.count(F.lit(1)).alias("left_rows"))
    per_key = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    joined = left.select(*keys).join(per_key, keys, "left").agg(
        F.sum(F.coalesce("_c", F.lit(1))).alias("joined_rows")
    )
    dups = per_key.agg(F.count_if(F.col("_c") > 1).alias("right_duplicates"))
    return with_scalars(with_scalars(n_left, joined), dups).withColumn(
        "one_to_one",
        (F.col("left_rows") == F.col("joined_rows")) & (F.col("right_duplicates") == 0),
    )


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {','.join(missing)}")
    return df


def schema_fingerprint(df: DataFrame) -> Column:
    """SHA-256 over the sorted ``name:type`` pairs of a schema."""
    pairs = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return F.sha2(F.lit("|".join(pairs)), 256)


def row_quality(
    df: DataFrame, group: list[str], key: list[str], required: list[str], expected: Column
) -> DataFrame:
    """Duplicates, critical nulls, completeness and invalid OHLC per group in one pass."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    good = reduce(lambda a, b: a & b, [finite(p).isNotNull() & (p > 0) for p in prices])
    good = (
        good & (F.col("low") <= F.least("open", "close"))
        & (F.col("high") >= F.greatest("open", "close"))
    )
    per_key = df.groupBy(*group, *[k for k in key if k not in group]).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(null).alias("_null"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("_bad"),
    )
    return (
        per_key.groupBy(*group)
        .agg(
            F.sum("_n").alias("rows"),
            F.sum(F.col("_n") - 1).alias("duplicate_keys"),
            F.sum("_null").alias("critical_nulls"),
            F.sum("_bad").alias("invalid_ohlc"),
        )
        .withColumn("completeness", F.least(F.col("rows") / expected, F.lit(1.0)))
    )


def coverage(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Share of finite values per feature and segment, long form."""
    aggs = [F.avg(F.when(finite(f).isNotNull(), 1.0).otherwise(0.0)).alias(f) for f in features]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.unpivot(by, features, "feature", "share")


def coverage_breaches(cover: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    floor = F.element_at(
        F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))]),
        F.col("feature"),
    )
    return cover.withColumn("floor", floor).where(F.col("share") < F.col("floor"))


def nested_completeness(stages: list[tuple[str, Column]]) -> tuple[list[Column], Column]:
    """Cumulative stage flags and the name of the first failing stage.

    Each stage requires all stages before it.
    """
    flags: list[Column] = []
    so_far = F.lit(True)
    for name, ok in stages:
        so_far = so_far & F.coalesce(ok, F.lit(False))
        flags.append(so_far.alias(f"{name}_complete"))
    reason = F.lit(None).cast("string")
    for name, ok in reversed(stages):
        reason = F.when(~F.coalesce(ok, F.lit(False)), f"{name.upper()}_INCOMPLETE").otherwise(reason)
    return flags, F.coalesce(reason, F.lit("NONE"))


def common_mask(target: str, keys: list[str], availability: list[str]) -> Column:
    """Valid target, keys and availability; missing features do not exclude a row."""
    parts = [finite(target).isNotNull() & (F.col(target) > 0)]
    parts += [F.col(k).isNotNull() for k in keys]
    parts += [finite(a).isNotNull() for a in availability]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def purge(df: DataFrame, test_start_us: Column, horizon: int, purge_min: int, embargo: int) -> DataFrame:
    """Training origins that end before the protected band in front of a test block."""
    guard = (max(horizon, purge_min) + embargo) * 60 * MICROS
    return df.where(F.col("origin_us") <= test_start_us - F.lit(guard))


def freeze_assets(
    quality: DataFrame, least: int = 4, most: int = 6, completeness: float = 0.95,
    duplicate_rate: float = 0.0, null_rate: float = 0.0,
) -> DataFrame:
    """The 4 to 6 best assets by quality alone, with their common history interval."""
    passing = quality.where(
        (F.col("completeness") >= completeness)
        & (F.col("duplicate_rate") <= duplicate_rate)
        & (F.col("null_rate") <= null_rate)
    )
    best = passing.orderBy(
        F.desc("completeness"), "duplicate_rate", "null_rate",
        F.desc(F.datediff("history_end", "history_start")), "asset",
    ).limit(most)
    common = best.agg(
        F.max("history_start").alias("common_start"), F.min("history_end").alias("common_end"),
        F.count(F.lit(1)).alias("_n"),
    )
    return (
        with_scalars(best.select("asset"), common)
        .where((F.col("_n") >= least) & (F.col("common_start") <= F.col("common_end")))
        .drop("_n")
    )


def continuity_verdict(rows: DataFrame, expected: DataFrame, keys: list[str], passes: list[str]) -> DataFrame:
    """One row: duplicates, missing, unexpected and failing keys and the verdict."""
    failing = ~reduce(lambda a, b: a & b, [F.coalesce(F.col(p), F.lit(False)) for p in passes])
    per = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(failing.cast("int")).alias("_fail")
    ).withColumn("_have", F.lit(1))
    both = expected.select(*keys).distinct().withColumn("_want", F.lit(1)).join(per, keys, "full")
    return both.agg(
        F.count_if(F.col("_n") > 1).alias("duplicated"),
        F.count_if(F.col("_have").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("unexpected"),
        F.count_if(F.col("_fail") == 1).alias("failing"),
    ).withColumn(
        "verdict",
        F.when(F.col("duplicated") > 0, "DUPLICATE")
        .when(F.col("missing") + F.col("unexpected") > 0, "INCOMPLETE")
        .when(F.col("failing") > 0, "PROVIDER_FAILURE")
        .otherwise("PASS"),
    )


def assign_role(day: Column, bounds: list[tuple[str, str]]) -> Column:
    """Role of a date from (role, last date) pairs in time order."""
    out = None
    for role, last in bounds:
        cond = day <= F.lit(last).cast("date")
        out = F.when(cond, role) if out is None else out.when(cond, role)
    return out


def role_order(df: DataFrame, role: str, day: str) -> DataFrame:
    """First and last date per role; ``ordered`` is false where a role starts too early."""
    from pyspark.sql import Window

    spans = df.groupBy(role).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    prev = F.lag("last").over(Window.orderBy("first"))
    return spans.withColumn("ordered", F.coalesce(F.col("first") > prev, F.lit(True)))


def refuse_sealed(df: DataFrame, roles: DataFrame, sealed: str, day: str = "session_date") -> DataFrame:
    """Pass rows through; a row of a sealed role fails the job."""
    tagged = df.join(roles.select(day, "role"), day, "left")
    return tagged.where(
        F.when(F.col("role") == sealed, F.raise_error(F.lit("sealed role read")).cast("boolean"))
        .otherwise(True)
    ).drop("role")


def sealed_findings(df: DataFrame, roles: DataFrame, sealed: str, keys: list[str], day: str = "session_date") -> DataFrame:
    """What ``refuse_sealed`` would stop at, over all rows: counts per key, the sealed days touched, and a verdict.

    Rows are counted per key and day before roles are joined.  A day without a role is told apart;
    it is not sealed, but no role allows it either.
    """
    days = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    tagged = days.join(roles.select(day, "role"), day, "left")
    hit, none = F.col("role") == sealed, F.col("role").isNull()
    of = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(F.lit(0).cast("bigint")))
    out = tagged.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), of(hit).alias("sealed_rows"), of(none).alias("rows_without_role"),
        F.min(F.when(hit, F.col(day))).alias("first_sealed"), F.count_if(hit).alias("sealed_days"))
    verdict = F.when(F.col("sealed_rows") > 0, "REFUSED").when(F.col("rows_without_role") > 0, "UNASSIGNED").otherwise("PASS")
    return out.withColumn("verdict", verdict)


def session_bounds_audit(origins: DataFrame, calendar: DataFrame) -> DataFrame:
    """Origins inside, before, after their session and on days without one."""
    c = calendar.select("session_date", "open_us", "close_us", "minutes")
    j = origins.join(c, "session_date", "left")
    o = F.col("origin_us")
    closed = F.coalesce(F.col("minutes"), F.lit(0)) == 0
    return j.groupBy("asset").agg(
        F.count(F.lit(1)).alias("origins"),
        F.count_if(~closed & (o >= F.col("open_us")) & (o <= F.col("close_us"))).alias("inside"),
        F.count_if(~closed & (o < F.col("open_us"))).alias("before_open"),
        F.count_if(~closed & (o > F.col("close_us"))).alias("after_close"),
        F.count_if(closed).alias("no_session"),
    )


def with_folds(df: DataFrame, folds: list[tuple[int, str, str, str]]) -> DataFrame:
    """Every row beside every declared fold (fold, train_end, test_start, test_end)."""
    rows = [
        F.struct(
            F.lit(n).cast("bigint").alias("fold"), F.lit(a).cast("date").alias("train_end"),
            F.lit(b).cast("date").alias("test_start"), F.lit(c).cast("date").alias("test_end"),
        )
        for n, a, b, c in folds
    ]
    for _, a, b, c in folds:
        if not a < b <= c:
            raise ValueError("fold dates out of order")
    return df.withColumn("_f", F.explode(F.array(*rows))).select("*", "_f.*").drop("_f")


def causal_audit(
    panel: DataFrame, folds: list[tuple[int, str, str, str]], horizon: int, embargo: int
) -> DataFrame:
    """Per fold: raw and retained training rows, the gap in minutes, and whether it is causal.

    The panel is reduced to one row per (date, instant) before the folds multiply it.
    """
    guard = (horizon + embargo) * 60 * MICROS
    counted = panel.groupBy("session_date", "origin_us").agg(F.count(F.lit(1)).alias("n"))
    by_fold = with_folds(counted, folds)
    is_test = F.col("session_date").between(F.col("test_start"), F.col("test_end"))
    first_test = (
        by_fold.where(is_test)
        .groupBy("fold").agg(F.min("origin_us").alias("first_test"), F.sum("n").alias("test_rows"))
    )
    train = by_fold.where(F.col("session_date") <= F.col("train_end")).join(first_test, "fold")
    kept = F.col("origin_us") <= F.col("first_test") - F.lit(guard)
    return train.groupBy("fold").agg(
        F.sum("n").alias("raw_rows"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("retained_rows"),
        F.max("test_rows").alias("test_rows"),
        ((F.max("first_test") - F.max(F.when(kept, F.col("origin_us")))) / 60e6).alias("gap_minutes"),
        F.coalesce(F.max(F.when(kept, F.col("origin_us"))) < F.max("first_test"), F.lit(False)).alias(
            "causal_pass"
        ),
    )


def slot_diagnostics(bars: DataFrame, slots: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Expected against observed slots per group: present, missing and extra."""
    have = bars.select(*keys).distinct().withColumn("_h", F.lit(1))
    want = slots.select(*keys).distinct().withColumn("_w", F.lit(1))
    return want.join(have, keys, "full").groupBy(*by).agg(
        F.count("_w").alias("expected"),
        F.count_if(F.col("_w").isNotNull() & F.col("_h").isNotNull()).alias("observed"),
        F.count_if(F.col("_h").isNull()).alias("missing"),
        F.count_if(F.col("_w").isNull()).alias("extra"),
    )
