"""Feature preparation, model families and evaluation loops on Spark ML and moment sums."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import VARIANCE_FLOOR, finite, floored, qlike, transform, with_scalars
from . import boosting as B
from . import regression as R
from .quantiles import group_quantiles
from .sampling import hash32

MIN_SCALE = 1e-12


@dataclass(frozen=True)
class Preprocessor:
    """Training statistics of one fold: medians, means, scales and indicator features."""

    features: tuple[str, ...]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    indicators: tuple[str, ...]

    def columns(self) -> dict[str, Column]:
        """Imputed and scaled columns, then a missingness flag per indicator feature."""
        out = {}
        for f in self.features:
            x = F.coalesce(finite(F.col(f).cast("double")), F.lit(self.median[f]))
            out[f"z_{f}"] = (x - self.mean[f]) / self.scale[f]
        for f in self.indicators:
            out[f"missing_{f}"] = F.when(finite(F.col(f).cast("double")).isNull(), 1.0).otherwise(0.0)
        return out


def fit_preprocessor(df: DataFrame, features: list[str], training: Column) -> Preprocessor:
    """Learn from training rows only; a feature absent there raises.

    Medians are exact over any number of rows.  The mean and deviation of the filled column
    follow from the sums of the present values and the count of missing ones, so a handful of
    numbers per feature, not rows, comes back.
    """
    train = df.where(training)
    long = train.select(*[finite(F.col(f).cast("double")).alias(f) for f in features]).unpivot([], features, "feature", "x")
    facts = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    rows = facts.join(group_quantiles(long, ["feature"], "x", {"med": 0.5}), "feature", "left").collect()
    got = {r["feature"]: r for r in rows}
    absent = [f for f in features if f not in got or got[f]["k"] == 0]
    if absent:
        raise ValueError(f"features absent in training: {','.join(absent)}")
    mean, scale = {}, {}
    for f in features:
        r = got[f]
        w = r["k"] / r["n"]
        mean[f] = w * r["m"] + (1 - w) * r["med"]
        var = w * (r["v"] + (r["m"] - mean[f]) ** 2) + (1 - w) * (r["med"] - mean[f]) ** 2
        scale[f] = var**0.5 if var**0.5 > MIN_SCALE else 1.0
    return Preprocessor(tuple(features), {f: got[f]["med"] for f in features}, mean, scale,
                        tuple(f for f in features if got[f]["k"] < got[f]["n"]))


def registry_columns(registry: dict[str, str]) -> dict[str, Column]:
    """Design columns in registry order with their registered transforms."""
    return {f"t_{name}": transform(name, kind) for name, kind in registry.items()}


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """One vector per row; a null or a missing column raises."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def elastic_net(df: DataFrame, features: list[str], training: Column, alpha: float = 0.01, l1: float = 0.5) -> DataFrame:
    """Elastic net on the log target from one moment pass; forecasts with the lognormal factor."""
    x, k = [F.lit(1.0), *[F.col(f) for f in features]], len(features) + 1
    mom = R.moments(df.where(training), [], x, [F.log(floored("target", VARIANCE_FLOOR))])
    fit = R.elastic_net_path(mom, [], k, [alpha], l1).withColumn("smearing", F.exp(0.5 * R.residual_variance(None, "coef", k)))
    return with_scalars(df, fit.select("coef", "smearing")).withColumn("forecast", R.predict_level(x)).drop("coef", "smearing")


def positive_glm(df: DataFrame, features: list[str], training: Column, family: str = "gamma", power: float = 1.7, alpha: float = 1e-4) -> DataFrame:
    """Gamma or Tweedie GLM with a log link, fitted on the variance scale; the constant is penalised too."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    fit = R.positive_glm(df, [], x, F.col("target"), training, 2.0 if family == "gamma" else power, alpha)
    return with_scalars(df, fit.select("coef")).withColumn("forecast", F.exp(R.predict("coef", x))).drop("coef")


def spline_basis(x: Column, lo: float, hi: float, knots: int = 6) -> list[Column]:
    """Uniform cubic B-splines on [lo, hi], constant outside; one function is dropped.

    Each is the cardinal cubic B-spline of (x - center) / spacing, a piecewise polynomial.
    """
    step = (hi - lo) / (knots - 1)
    c = F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
    out = []
    for i in range(knots + 1):
        u = F.abs((c - (lo + (i - 1) * step)) / step)
        near = (4.0 - 6.0 * u * u + 3.0 * u * u * u) / 6.0
        far = F.pow(2.0 - u, 3.0) / 6.0
        out.append(F.when(u < 1, near).when(u < 2, far).otherwise(0.0))
    return out


def additive_spline(df: DataFrame, features: list[str], training: Column, alpha: float = 1.0) -> DataFrame:
    """Sum of per-feature splines on the log target, ridge-penalised, from one moment pass."""
    ends = df.where(training).agg(*[F.min(f).alias(f"{f}_lo") for f in features], *[F.max(f).alias(f"{f}_hi") for f in features]).collect()[0]
    x = [F.lit(1.0)]
    for f in features:
        x += spline_basis(F.col(f), float(ends[f"{f}_lo"]), float(ends[f"{f}_hi"]))
    fit = R.fit_log_linear(df, [], x, F.col("target"), training, alpha, True)
    return with_scalars(df, fit).withColumn("forecast", R.predict_level(x)).drop("coef", "smearing", "train_rows")


def boosted_ensembles(df: DataFrame, ensembles: dict[str, B.Ensemble], training: Column, **options) -> tuple[DataFrame, B.Fitted]:
    """Adds ``forecasts``, a struct of one variance forecast per ensemble, and gives the fit.

    Ensembles on the log target carry the lognormal factor of their training residuals; those on
    QLIKE aim at the mean itself and need none.
    """
    fit = B.fit(df, ensembles, F.col("target"), training, **options)
    raw = fit.forecasts(df)
    factor = {n: math.exp(0.5 * fit.residual_variance(n)) for n, e in ensembles.items() if e.loss == "log"}
    clipped = lambda n: F.greatest(F.lit(-B.CLIP), F.least(F.lit(B.CLIP), F.col(f"raw.{n}")))
    level = [(F.exp(F.col(f"raw.{n}")) * factor[n] if n in factor else F.exp(clipped(n))).alias(n) for n in ensembles]
    return raw.withColumn("forecasts", F.struct(*level)).drop("raw"), fit


def boosted(df: DataFrame, features: list[str], training: Column, monotone: dict[str, int] | None = None, **options) -> tuple[DataFrame, dict[str, float]]:
    """Boosted trees on the log target, with the gain by feature."""
    out, fit = boosted_ensembles(df, {"log": B.Ensemble("log", tuple(features), monotone or {})}, training, **options)
    return out.withColumn("forecast", F.col("forecasts.log")).drop("forecasts"), fit.gains["log"]


def boosted_qlike(df: DataFrame, features: list[str], training: Column, monotone: dict[str, int] | None = None, **options) -> DataFrame:
    """Boosted trees that descend QLIKE itself, by Newton steps from the mean log target."""
    out, _ = boosted_ensembles(df, {"qlike": B.Ensemble("qlike", tuple(features), monotone or {})}, training, **options)
    return out.withColumn("forecast", F.col("forecasts.qlike")).drop("forecasts")


def partial_pooling(df: DataFrame, group: str, residual: str, training: Column) -> DataFrame:
    """Per-group offsets shrunk by tau2 / (tau2 + sigma2 / n), by moments."""
    g = df.where(training & finite(residual).isNotNull()).groupBy(group).agg(
        F.avg(residual).alias("group_mean"), F.count(F.lit(1)).alias("n"), F.sum(F.col(residual) * F.col(residual)).alias("_q"))
    w = g.agg(
        (F.sum(F.col("group_mean") * F.col("n")) / F.sum("n")).alias("grand_mean"), F.var_pop("group_mean").alias("_spread"), F.avg("n").alias("_an"),
        (F.sum("_q") / F.sum("n") - F.pow(F.sum(F.col("group_mean") * F.col("n")) / F.sum("n"), 2.0)).alias("_within"))
    j = with_scalars(g, w)
    between = F.greatest(F.col("_spread") - F.col("_within") / F.col("_an"), F.lit(0.0))
    j = j.withColumn("between_variance", between)
    b = F.col("between_variance")
    weight = F.when(b > 0, b / (b + F.col("_within") / F.col("n"))).otherwise(0.0)
    return j.select(group, "n", "group_mean", "grand_mean", "between_variance", (weight * (F.col("group_mean") - F.col("grand_mean"))).alias("offset"))


def garch_grid(returns: DataFrame, keys: list[str], session: str, order: str, r: str, alphas: list[float], betas: list[float], horizon: int) -> DataFrame:
    """GARCH(1,1) per key by variance targeting over an (alpha, beta) grid.

    h <- omega + alpha r^2 + beta h is affine in h, so a session maps its entering variance to
    its leaving one with two numbers.  Sessions are folded in order per (key, grid point) on
    those numbers; the likelihood is then summed inside every session in parallel.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in alphas for b in betas if a + b < 0.999]))
    clean = returns.where(F.col(r).isNotNull())
    var = clean.groupBy(*keys).agg(F.var_pop(r).alias("_v"))
    sess = clean.groupBy(*keys, session).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(r).alias("r")))).alias("_r"))
    s = sess.join(var, keys).where(F.col("_v") > 0).withColumn("_g", grid).select(*keys, session, "_r", "_v", "_g.*").withColumn(
        "_w", F.col("_v") * (1.0 - F.col("alpha") - F.col("beta")))
    gk = [*keys, "alpha", "beta"]

    def push(h: Column, x: Column) -> Column:
        return F.col("_w") + F.col("alpha") * x["r"] * x["r"] + F.col("beta") * h

    maps = s.withColumn("_b", F.aggregate("_r", F.lit(0.0), push)).withColumn("_a", F.pow(F.col("beta"), F.size("_r").cast("double")))
    days = maps.groupBy(*gk, "_v").agg(F.sort_array(F.collect_list(F.struct(F.col(session).alias("d"), F.col("_a").alias("a"), F.col("_b").alias("b")))).alias("_days"))
    start_type = f"array<struct<d:{dict(returns.dtypes)[session]},h:double>>"
    zero = F.struct(F.col("_v").alias("h"), F.array().cast(start_type).alias("out"))
    folded = days.withColumn("_f", F.aggregate("_days", zero, lambda acc, x: F.struct(
        (x["a"] * acc["h"] + x["b"]).alias("h"), F.concat(acc["out"], F.array(F.struct(x["d"].alias("d"), acc["h"].alias("h")))).alias("out"))))
    starts = folded.select(*gk, F.explode("_f.out").alias("_o")).select(*gk, F.col("_o.d").alias(session), F.col("_o.h").alias("_h0"))
    like0 = F.struct(F.col("_h0").alias("h"), F.lit(0.0).alias("l"))

    def like(acc: Column, x: Column) -> Column:
        h = F.greatest(acc["h"], F.lit(1e-18))
        return F.struct(push(acc["h"], x).alias("h"), (acc["l"] + 0.5 * (F.log(h) + x["r"] * x["r"] / h)).alias("l"))

    nll = s.join(starts, [*gk, session]).withColumn("_l", F.aggregate("_r", like0, like)["l"]).groupBy(*gk).agg(F.sum("_l").alias("nll"))
    last = folded.select(*gk, F.col("_v").alias("variance"), F.col("_f.h").alias("next_variance"))
    best = nll.join(last, gk).groupBy(*keys).agg(F.min_by(F.struct("alpha", "beta", "nll", "variance", "next_variance"), F.struct("nll", "alpha", "beta")).alias("_b")).select(*keys, "_b.*")
    p = F.col("alpha") + F.col("beta")
    geo = (1.0 - F.pow(p, F.lit(float(horizon)))) / (1.0 - p)
    return best.withColumn("forecast", horizon * F.col("variance") + geo * (F.col("next_variance") - F.col("variance")))


def split_folds(df: DataFrame, folds: list[tuple[int, str, str, str]], inner_sessions: int, guard_us: int) -> DataFrame:
    """Rows of each expanding fold with part fit, validate, test or purged.

    The last ``inner_sessions`` training sessions validate; rows whose label reaches into a
    later part are purged.  Only distinct sessions are ranked.  What a fold knows is one row of the
    declared folds and is broadcast: a shuffle by fold would put a fold's rows into one task.
    """
    from .quality import with_folds

    placed = with_folds(df, folds)
    is_train = F.col("session_date") <= F.col("train_end")
    is_test = F.col("session_date").between(F.col("test_start"), F.col("test_end"))
    days = with_folds(df.select("session_date").distinct(), folds).where(is_train)
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("session_date")))
    inner = days.withColumn("_r", rank).where(F.col("_r") <= inner_sessions).groupBy("fold").agg(F.min("session_date").alias("_v0"))
    firsts = placed.join(F.broadcast(inner), "fold").groupBy("fold", "_v0").agg(
        F.min(F.when(is_test, F.col("origin_us"))).alias("_t0"),
        F.min(F.when(is_train & (F.col("session_date") >= F.col("_v0")), F.col("origin_us"))).alias("_u0"))
    j = placed.where(is_train | is_test).join(F.broadcast(firsts), "fold")
    late = F.col("session_date") >= F.col("_v0")
    part = (
        F.when(is_test, "test").when(late & (F.col("origin_us") <= F.col("_t0") - guard_us), "validate")
        .when(~late & (F.col("origin_us") <= F.col("_u0") - guard_us), "fit").otherwise("purged"))
    return j.withColumn("part", part).drop("_v0", "_t0", "_u0", "train_end", "test_start", "test_end")


def scale_by_fit(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Adds ``s_<feature>``, standardised by the mean and deviation of part fit of the same key.

    Keys are declared folds and the like; their statistics are broadcast.
    """
    own = df.where(F.col("part") == "fit").groupBy(*keys).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    scaled = {f"s_{f}": (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) for f in features}
    return df.join(F.broadcast(own), keys).withColumns(scaled).drop(*[f"_{k}_{f}" for k in "ms" for f in features])


def tune_ridge(df: DataFrame, keys: list[str], x: list[Column], target: str, alphas: list[float]) -> DataFrame:
    """Rows of part test with the forecast of their key's :func:`tuned_fits`."""
    final = tuned_fits(df, keys, x, target, alphas)
    return df.where(F.col("part") == "test").join(F.broadcast(final), keys).withColumn("forecast", R.predict_level(x)).drop("coef", "smearing")


def tuned_fits(df: DataFrame, keys: list[str], x: list[Column], target: str, alphas: list[float]) -> DataFrame:
    """Ridge per key and penalty on part fit, chosen by QLIKE on part validate, refitted: ``keys, alpha, coef, smearing, validation_qlike``.

    The penalties share one set of moment sums; a refit is a sum of two sets.  Keys are declared
    folds and the like; their fits are broadcast.
    """
    k = len(x)
    y = F.log(floored(target, VARIANCE_FLOOR))
    mom = R.moments(df.where(F.col("part").isin("fit", "validate")), [*keys, "part"], x, [y])
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))

    def fits(m: DataFrame) -> DataFrame:
        wide = m.withColumn("alpha", grid)
        for i in range(1, k):
            wide = wide.withColumn(f"_g{i}_{i}", F.col(f"_g{i}_{i}") + F.col("alpha"))
        s = R.solve(wide, k, 1)
        for i in range(1, k):
            s = s.withColumn(f"_g{i}_{i}", F.col(f"_g{i}_{i}") - F.col("alpha"))
        return s.withColumn("smearing", F.exp(0.5 * R.residual_variance(None, "coef", k))).select(*keys, "alpha", "coef", "smearing")

    first = fits(mom.where(F.col("part") == "fit").drop("part"))
    score = df.where(F.col("part") == "validate").join(F.broadcast(first), keys).groupBy(*keys, "alpha").agg(
        F.avg(qlike(F.col(target), R.predict_level(x))).alias("validation_qlike"))
    best = score.groupBy(*keys).agg(F.min_by(F.struct("alpha", "validation_qlike"), F.struct("validation_qlike", "alpha")).alias("_b")).select(*keys, "_b.*")
    return fits(R.add_up(mom, keys, k, 1)).join(best, [*keys, "alpha"])


def walk_forward(df: DataFrame, keys: list[str], block: str, x: list[Column], target: str, warmup: int, ridge: float = 0.0) -> DataFrame:
    """Forecast each block from a fit on all earlier blocks, after a warm-up.

    Block moments are one row per block; a running sum over them gives every expanding fit.
    """
    k = len(x)
    mom = R.moments(df, [*keys, block], x, [F.log(floored(target, VARIANCE_FLOOR))])
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.count(F.lit(1)).over(w)
    run = mom.select(*keys, block, seen.alias("_seen"), *[F.sum(c).over(w).alias(c) for c in R.moment_columns(k, 1)]).where(F.col("_seen") >= warmup)
    fit = R.solve(run, k, 1, ridge, (False,) + (True,) * (k - 1))
    fit = fit.withColumn("smearing", F.exp(0.5 * R.residual_variance(None, "coef", k))).select(*keys, block, "coef", "smearing")
    return df.join(fit, [*keys, block]).withColumn("forecast", R.predict_level(x)).drop("coef", "smearing")


def leave_one_out(df: DataFrame, group: str, x: list[Column], target: str, training: Column) -> DataFrame:
    """Forecast each group from a fit on the training rows of all others: total moments less the group's.

    Every row gets a forecast that neither its own group nor any row outside training has shaped.
    """
    k = len(x)
    mom = R.moments(df.where(training), [group], x, [F.log(floored(target, VARIANCE_FLOOR))])
    every = df.select(group).distinct().join(mom, group, "left").fillna(0, R.moment_columns(k, 1))
    total = R.add_up(mom, [], k, 1)
    both = with_scalars(every, total.select(*[F.col(c).alias(f"t{c}") for c in R.moment_columns(k, 1)]))
    rest = both.select(group, *[(F.col(f"t{c}") - F.col(c)).alias(c) for c in R.moment_columns(k, 1)])
    fit = R.solve(rest, k, 1).withColumn("smearing", F.exp(0.5 * R.residual_variance(None, "coef", k))).select(group, "coef", "smearing")
    return df.join(fit, group).withColumn("forecast", R.predict_level(x)).drop("coef", "smearing")


def residualise(df: DataFrame, keys: list[str], x: list[Column], flow: str, training: Column, name: str = "abnormal") -> DataFrame:
    """Flow less its linear expectation, fitted on training rows."""
    fit = R.solve(R.moments(df.where(training), keys, x, [F.col(flow)]), len(x), 1).select(*keys, "coef")
    return df.join(fit, keys).withColumn(name, F.col(flow) - R.predict("coef", x)).drop("coef")


def interactions(flows: list[str], group: str, levels: list[str]) -> dict[str, Column]:
    """Flow columns and their products with group dummies."""
    out = {f: F.col(f) for f in flows}
    for lv in levels:
        hit = F.when(F.col(group) == lv, 1.0).otherwise(0.0)
        out |= {f"{f}__{lv}": F.col(f) * hit for f in flows}
    return out


def training_levels(df: DataFrame, group: str, training: Column, most: int = 200) -> list[str]:
    """Levels of a group among training rows, in order; rows of others get no interaction.

    They become columns of a plan, so more than ``most`` raise; none are left out.
    """
    found = sorted(r[0] for r in df.where(training & F.col(group).isNotNull()).select(group).distinct().limit(most + 1).collect())
    if not found or len(found) > most:
        raise ValueError(f"{group} has {'no level' if not found else f'over {most} levels'} in training")
    return found


def residual_learner(df: DataFrame, columns: dict[str, Column], residual: str, base: str, training: Column, alpha: float = 1.0) -> DataFrame:
    """Ridge correction of a base forecast learned on its cross-fitted residual."""
    x = [F.lit(1.0), *columns.values()]
    mom = R.moments(df.where(training), [], x, [F.col(residual)])
    fit = R.solve(mom, len(x), 1, alpha, (False,) + (True,) * len(columns)).select("coef")
    out = with_scalars(df, fit).withColumn("correction", R.predict("coef", x)).drop("coef")
    return out.withColumn("corrected", floored(F.col(base) + F.col("correction"), VARIANCE_FLOOR))


def permute_within(df: DataFrame, keys: list[str], value: str, tie: str, seed: int, name: str = "permuted") -> DataFrame:
    """Placebo: values permuted by hash order inside each key (a session), keys unchanged."""
    a = Window.partitionBy(*keys).orderBy(tie)
    b = Window.partitionBy(*keys).orderBy(hash32(seed, F.col(tie)), F.col(tie))
    ranked = df.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b))
    moved = ranked.select(*keys, F.col("_b").alias("_a"), F.col(value).alias(name))
    return ranked.join(moved, [*keys, "_a"]).drop("_a", "_b")


def inclusion_weights(df: DataFrame, features: list[str], included: str, cap: float = 10.0, reg: float = 0.0) -> DataFrame:
    """Logistic inclusion model and clipped inverse-probability weights."""
    d = assemble(df.withColumn("_l", F.col(included).cast("double")), features)
    m = LogisticRegression(labelCol="_l", probabilityCol="_p", regParam=reg, maxIter=50).fit(d)
    from pyspark.ml.functions import vector_to_array

    out = m.transform(d).withColumn("inclusion_p", vector_to_array("_p")[1])
    share = d.agg(F.avg("_l").alias("_m"))
    return with_scalars(out, share).withColumn(
        "weight", F.least(F.col("_m") / floored("inclusion_p", 1e-6), F.lit(cap))).drop("_l", "_p", "_m", "features", "rawPrediction", "prediction")


def weighted_contrast(df: DataFrame, keys: list[str], value: str, weight: str, day: str = "session_date") -> DataFrame:
    """Weighted and plain session means of a loss difference."""
    return df.groupBy(*keys, day).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.avg(value).alias("plain_mean"))
