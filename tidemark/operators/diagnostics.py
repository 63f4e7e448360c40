"""Ledgers, waterfalls, coverage decisions, distribution and collinearity diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, floor_div, latency_seconds, with_scalars
from .panes import with_panes
from .quantiles import group_quantiles, histogram_quantile, latency_histogram, quantiles_of_counts

ALL = "ALL"


def with_scopes(df: DataFrame, dims: list[str]) -> DataFrame:
    """Each row under every combination of its dimension values and ALL."""
    out = df
    for c in dims:
        out = out.withColumn(c, F.explode(F.array(F.lit(ALL), F.col(c))))
    return out


def scoped_quantiles(
    df: DataFrame, dims: list[str], value: Column, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles at every scope; values are counted before the scopes multiply rows."""
    counted = (
        df.select(*dims, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
        .groupBy(*dims, "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    up = with_scopes(counted, dims).groupBy(*dims, "_v").agg(F.sum("_c").alias("_c"))
    return quantiles_of_counts(up, dims, probs)


def scoped_sums(df: DataFrame, dims: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Additive measures at every scope, summed at the finest grain first."""
    fine = df.groupBy(*dims).agg(*[F.sum(c).alias(n) for n, c in aggs.items()])
    return with_scopes(fine, dims).groupBy(*dims).agg(*[F.sum(n).alias(n) for n in aggs])


def latency_ledger(tape: DataFrame, by: list[str], backfill_s: float = 60.0) -> DataFrame:
    """Additive latency facts per group: rows, non-positive, backfilled, duplicates, min, max, sum."""
    lat = latency_seconds(F.col("created_us"), F.col("executed_us"))
    cross = F.floor(F.col("created_us") / 86_400e6) != F.floor(F.col("executed_us") / 86_400e6)
    per_id = tape.groupBy(*by, "id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((lat <= 0).cast("int")).alias("_np"),
        F.sum((lat > backfill_s).cast("int")).alias("_bf"), F.sum(cross.cast("int")).alias("_x"),
        F.min(lat).alias("_lo"), F.max(lat).alias("_hi"), F.sum(lat).alias("_s"))
    return per_id.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.sum("_np").alias("non_positive"), F.sum("_bf").alias("over_backfill"),
        F.sum(F.col("_n") - 1).alias("duplicate_ids"), F.sum("_x").alias("cross_session"),
        F.min("_lo").alias("min_s"), F.max("_hi").alias("max_s"), F.sum("_s").alias("total_s"))


def recommended_cutoff(p95: Column, multiplier: float = 2.0, floor: float = 60.0) -> Column:
    return F.greatest(F.lit(floor), F.ceil(multiplier * p95).cast("double"))


def session_admissibility(stats: DataFrame, cutoff: Column, max_backfill: float = 0.01) -> DataFrame:
    """Reasons a session's latency disqualifies it; reads p95_s and backfill_share."""
    late = F.when(F.col("p95_s").isNull() | (F.col("p95_s") > cutoff), "P95_ABOVE_CUTOFF")
    back = F.when(F.col("backfill_share") > max_backfill, "BACKFILL_ABOVE_CEILING")
    reason = F.concat_ws("+", late, back)
    return stats.withColumn("reason", F.when(reason == "", "OK").otherwise(reason)).withColumn(
        "admissible", F.col("reason") == "OK")


def stability_verdict(session_p95: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Whether the largest session p95 stays within tolerance x the median; one row per session."""
    ok = session_p95.where(F.col("p95_s") > 0)
    return ok.agg(F.max("p95_s").alias("max_p95"), F.percentile("p95_s", F.lit(0.5)).alias("median_p95")).withColumn(
        "stable", F.coalesce(F.col("max_p95") <= tolerance * F.col("median_p95"), F.lit(False)))


def latency_summary(tape: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Completeness, negatives, quantiles and share within cutoffs: global, cohort, cohort x asset,
    cohort x session."""
    lat = latency_seconds(F.col("created_us"), F.col("executed_us"))
    scopes = F.array(
        F.struct(F.lit(ALL).alias("cohort"), F.lit(ALL).alias("session"), F.lit(ALL).alias("asset")),
        F.struct(F.col("role").alias("cohort"), F.lit(ALL).alias("session"), F.lit(ALL).alias("asset")),
        F.struct(F.col("role").alias("cohort"), F.col("session_date").cast("string").alias("session"), F.lit(ALL).alias("asset")),
        F.struct(F.col("role").alias("cohort"), F.lit(ALL).alias("session"), F.col("asset").alias("asset")),
    )
    fine = (
        tape.groupBy("role", "session_date", "asset", lat.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_s", F.explode(scopes))
        .select("_s.*", "_v", "_c")
        .groupBy("cohort", "session", "asset", "_v").agg(F.sum("_c").alias("_c"))
    )
    keys = ["cohort", "session", "asset"]
    facts = fine.groupBy(*keys).agg(
        F.sum("_c").alias("rows"), F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("incomplete"),
        F.sum(F.when(F.col("_v") < 0, F.col("_c")).otherwise(0)).alias("negative"),
        *[(F.sum(F.when(F.col("_v") <= c, F.col("_c")).otherwise(0)) / F.sum("_c")).alias(f"share_within_{c}s") for c in cutoffs])
    q = quantiles_of_counts(fine.where(F.col("_v").isNotNull()), keys, {"p50_s": 0.5, "p95_s": 0.95, "p99_s": 0.99})
    return facts.join(q, keys, "left")


def window_eligibility(
    tape: DataFrame, origins: DataFrame, step_us: int, panes: int, buffers: list[int]
) -> DataFrame:
    """Candidates, eligible, delayed and missing-created rows per (asset, session, buffer).

    A row is a candidate of each origin whose execution window holds it.
    """
    buf = F.explode(F.array(*[F.lit(b).cast("bigint") for b in buffers]))
    t = with_panes(tape.withColumn("buffer_s", buf), step_us, F.col("buffer_s"))
    counted = t.groupBy("asset", "buffer_s", "exec_pane", "seen_pane").agg(F.count(F.lit(1)).alias("_n"))
    k = F.explode(F.sequence(F.col("exec_pane") + 1, F.col("exec_pane") + panes))
    o = origins.select("asset", "session_date", floor_div(F.col("origin_us"), step_us).alias("k"))
    j = counted.withColumn("k", k).join(o, ["asset", "k"])
    seen = F.col("seen_pane")
    return j.groupBy("asset", "session_date", "buffer_s").agg(
        F.sum("_n").alias("candidates"),
        F.sum(F.when(seen <= F.col("k"), F.col("_n")).otherwise(0)).alias("eligible"),
        F.sum(F.when(seen > F.col("k"), F.col("_n")).otherwise(0)).alias("delayed"),
        F.sum(F.when(seen.isNull(), F.col("_n")).otherwise(0)).alias("missing_created"))


def window_counts(tape: DataFrame, origins: DataFrame, step_us: int, panes: int, delay_s: int) -> DataFrame:
    """Candidates, eligible and delayed rows of each origin's execution window."""
    t = with_panes(tape, step_us, delay_s)
    counted = t.groupBy("asset", "exec_pane", "seen_pane").agg(F.count(F.lit(1)).alias("_n"))
    at_k = counted.withColumn("k", F.explode(F.sequence(F.col("exec_pane") + 1, F.col("exec_pane") + panes)))
    sums = at_k.groupBy("asset", "k").agg(
        F.sum("_n").alias("candidates"),
        F.sum(F.when(F.col("seen_pane") <= F.col("k"), F.col("_n")).otherwise(0)).alias("eligible"))
    z = F.lit(0).cast("bigint")
    o = origins.withColumn("k", floor_div(F.col("origin_us"), step_us)).join(sums, ["asset", "k"], "left")
    return o.withColumns({c: F.coalesce(c, z) for c in ("candidates", "eligible")}).withColumn(
        "delayed", F.col("candidates") - F.col("eligible")).drop("k")


def availability_status(
    value: Column, delayed_source: Column, raw: Column, eligible: Column, delayed: Column, missing: Column
) -> Column:
    """Whether an activity value may be used, from its state and the state of its source."""
    invalid = value.isNull() | (value < 0)
    clean = F.when(invalid, "EXCLUDED_INVALID").when(value == 0, "USABLE_ZERO").otherwise("USABLE_ACTIVITY")
    doubt = (
        F.when(invalid, "EXCLUDED_INVALID").when(missing > 0, "EXCLUDED_MISSING_CREATED")
        .when((value == 0) & (delayed > 0), "EXCLUDED_DELAYED_TRADES")
        .when((value == 0) & (raw == 0), "EXCLUDED_DELAY_CONTEXT_ZERO")
        .when((value == 0) | (value != eligible), "EXCLUDED_COUNT_MISMATCH")
        .otherwise("USABLE_ACTIVITY_DELAY_CONTEXT"))
    return F.when(delayed_source, doubt).otherwise(clean)


def incident_audit(tape: DataFrame, expected: DataFrame, late_share: float = 0.02) -> DataFrame:
    """Rows, first and last times and delay state of each expected (session, asset)."""
    lat = latency_seconds(F.col("created_us"), F.col("executed_us"))
    a = tape.groupBy("session_date", "asset").agg(
        F.count(F.lit(1)).alias("rows"), F.min("executed_us").alias("first_us"), F.max("executed_us").alias("last_us"),
        F.avg(F.when(lat > 60, 1.0).otherwise(0.0)).alias("late_share"))
    state = (
        F.when(F.col("rows").isNull(), "ABSENT").when(F.col("late_share") > late_share, "DELAYED").otherwise("NORMAL"))
    return expected.join(a, ["session_date", "asset"], "left").withColumn("state", state).withColumn(
        "rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def reason_waterfall(rows: DataFrame, dims: list[str], reason: str) -> DataFrame:
    """Terminal reasons at every scope with their share of the scope."""
    fine = rows.groupBy(*dims, reason).agg(F.count(F.lit(1)).alias("n"))
    up = with_scopes(fine, dims).groupBy(*dims, reason).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*dims))
    return up.withColumn("origins", total).withColumn("share", F.col("n") / F.col("origins"))


def quote_quality(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Attempts, returned quotes, IV successes, age and spread quantiles and a failure map."""
    facts = scoped_sums(rows, dims, {
        "attempts": F.lit(1), "returned": F.col("quote_us").isNotNull().cast("int"),
        "iv_success": (F.col("reason") == "NONE").cast("int")})
    ages = scoped_quantiles(rows, dims, F.col("age_s"), {"median_age_s": 0.5, "p95_age_s": 0.95})
    spreads = scoped_quantiles(rows, dims, F.col("rel_spread"), {"median_spread": 0.5, "p95_spread": 0.95})
    fails = reason_waterfall(rows, dims, "reason").groupBy(*dims).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n"))))).alias("failures"))
    return facts.join(ages, dims, "left").join(spreads, dims, "left").join(fails, dims)


def lag_availability(rows: DataFrame, dims: list[str], features: list[str]) -> DataFrame:
    facts = scoped_sums(rows, dims, {
        "origins": F.lit(1), **{f"{f}_available": finite(f).isNotNull().cast("int") for f in features}})
    return facts.withColumns({f"{f}_rate": F.col(f"{f}_available") / F.col("origins") for f in features})


def feature_distributions(df: DataFrame, features: list[str]) -> DataFrame:
    """n, missing, mean, population std, exact p05, median, p95 and near-constant flag per feature."""
    long = df.select(*[finite(F.col(f).cast("double")).alias(f) for f in features]).unpivot([], features, "feature", "x")
    facts = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("finite_rows"),
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    q = group_quantiles(long, ["feature"], "x", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    tiny = F.greatest(F.abs(F.coalesce("mean", F.lit(0.0))) * 1e-10, F.lit(1e-12))
    return facts.join(q, "feature", "left").withColumn("missing", F.col("rows") - F.col("finite_rows")).withColumn(
        "near_constant", F.coalesce(F.col("std") <= tiny, F.lit(False)))


def collinearity(df: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise absolute correlations over complete rows, from one pass of moments."""
    x = [finite(F.col(f).cast("double")) for f in features]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in x])
    rows = df.where(whole).select(*[c.alias(f) for c, f in zip(x, features)])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    one = rows.agg(
        F.count(F.lit(1)).alias("complete_rows"),
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    names = [f"{a}|{b}" for a, b in pairs]
    return one.unpivot(["complete_rows"], names, "pair", "r").select(
        "complete_rows", F.split("pair", "\\|")[0].alias("feature_a"), F.split("pair", "\\|")[1].alias("feature_b"),
        F.abs("r").alias("abs_r"))


def coverage_decision(df: DataFrame, flag: str, dims: list[str], floors: dict[str, float]) -> DataFrame:
    """Global and smallest per-dimension coverage against its floors; one row."""
    fine = df.groupBy(*dims).agg(F.sum(F.col(flag).cast("bigint")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    out = fine.agg((F.sum("_s") / F.sum("_n")).alias("global_coverage"))
    for c in dims:
        part = fine.groupBy(c).agg((F.sum("_s") / F.sum("_n")).alias("_v")).agg(F.min("_v").alias(f"min_{c}_coverage"))
        out = with_scalars(out, part)
    passed = reduce(lambda a, b: a & b, [F.col(n) >= v for n, v in floors.items()])
    return out.withColumn("status", F.when(passed, "PASS").otherwise("REVISE"))


def coding_traceability(expected: DataFrame, coded: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How each partition encodes zero, missing and non-zero values against expected origins."""
    c = coded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("coded"), F.count_if(F.col(value).isNull()).alias("null_coded"),
        F.count_if(F.col(value) == 0).alias("zero_coded"), F.count_if(F.col(value) > 0).alias("nonzero_coded"))
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    z = F.lit(0).cast("bigint")
    j = e.join(c, keys, "left").withColumns({n: F.coalesce(n, z) for n in ("coded", "null_coded", "zero_coded", "nonzero_coded")})
    return j.withColumn("complete", F.col("coded") == F.col("expected"))


def source_coverage(rows: DataFrame, keys: list[str], reason: str, evidence: str) -> DataFrame:
    """Reason and evidence counts per partition as maps."""
    per = rows.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("_n"), F.count(evidence).alias("_e"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum("_e").alias("with_evidence"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(reason), F.col("_n")))))).alias("reasons"))


def timing_audit(selected: DataFrame, dims: list[str]) -> DataFrame:
    """Future quotes, ages, selected/none counts and usable share per cutoff and asset scope."""
    age = F.col("quote_age_s")
    facts = scoped_sums(selected, dims, {
        "requests": F.lit(1), "selected": age.isNotNull().cast("int"), "future": F.coalesce((age < 0).cast("int"), F.lit(0)),
        "usable": F.coalesce(F.col("usable").cast("int"), F.lit(0))})
    q = scoped_quantiles(selected, dims, age, {"median_age_s": 0.5})
    return facts.withColumn("none_found", F.col("requests") - F.col("selected")).join(q, dims, "left")


def role_summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("role").agg(
        F.count_distinct("session_date").alias("sessions"), F.min("session_date").alias("first"),
        F.max("session_date").alias("last"), F.concat_ws(",", F.sort_array(F.collect_set("asset"))).alias("assets"),
        F.sum("files").alias("files"), F.sum("rows").alias("rows"))


def scorecard(parts: dict[str, DataFrame]) -> DataFrame:
    """Several one-row summaries as (section, field, value) rows."""
    out = []
    for name, df in parts.items():
        cols = df.columns
        out.append(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "field", "value").select(
            F.lit(name).alias("section"), "field", "value"))
    return reduce(lambda a, b: a.unionByName(b), out)


def pooled_latency(tape: DataFrame, by: list[str], prob: float, name: str) -> DataFrame:
    lat = latency_seconds(F.col("created_us"), F.col("executed_us"))
    return histogram_quantile(latency_histogram(tape, by, lat), by, prob, name)


