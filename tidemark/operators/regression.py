"""Keyed linear models from moment sums.

One aggregation gives the sums of products per key; they add over sessions, folds, blocks and
assets, so every fold, leave-out or walk-forward fit is a sum or difference of them.  The k x k
systems are solved per key in Arrow batches; no row of data and no Gram matrix passes through
the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import VARIANCE_FLOOR, finite, floored, with_scalars
from ..functions.special import chi2_sf, t_two_sided

ARRAY = T.ArrayType(T.DoubleType())
#: Keys whose coefficients are broadcast.
FEW = 10_000


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moment_columns(k: int, m: int) -> list[str]:
    return ["_n", *[f"_g{i}_{j}" for i, j in pairs(k)], *[f"_c{i}_{j}" for i in range(k) for j in range(m)],
            *[f"_y{i}_{j}" for i, j in pairs(m)]]


def moments(df: DataFrame, keys: list[str], x: list[Column], y: list[Column], weight: Column | None = None) -> DataFrame:
    """Sums of (weighted) products of regressors and responses per key; rows with a null are left out."""
    k, m = len(x), len(y)
    named = df.select(
        *keys, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)], *[c.cast("double").alias(f"_r{i}") for i, c in enumerate(y)],
        *([] if weight is None else [weight.cast("double").alias("_w")]))
    named = named.dropna(subset=[*[f"_x{i}" for i in range(k)], *[f"_r{i}" for i in range(m)]])

    def total(a: str, b: str) -> Column:
        product = F.col(a) * F.col(b)
        return F.sum(product if weight is None else F.col("_w") * product)

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [total(f"_x{i}", f"_x{j}").alias(f"_g{i}_{j}") for i, j in pairs(k)]
    aggs += [total(f"_x{i}", f"_r{j}").alias(f"_c{i}_{j}") for i in range(k) for j in range(m)]
    aggs += [total(f"_r{i}", f"_r{j}").alias(f"_y{i}_{j}") for i, j in pairs(m)]
    return named.groupBy(*keys).agg(*aggs)


def array_moments(df: DataFrame, x: str, k: int, y: str) -> DataFrame:
    """:func:`moments` over all rows of ``k`` regressors in one array column and one response: one row per task, then one.

    For designs too wide for hundreds of sum expressions.  Rows with a null are left out.
    """
    names = moment_columns(k, 1)
    iu = np.triu_indices(k)

    def sums(batches):
        n, g, c, yy, seen = 0, np.zeros((k, k)), np.zeros(k), 0.0, False
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            r = b.column(1).to_numpy(zero_copy_only=False)
            n, g, c, yy, seen = n + len(r), g + v.T @ v, c + v.T @ r, yy + float(r @ r), True
        if seen:
            row = [float(n), *g[iu].tolist(), *c.tolist(), yy]
            yield pa.RecordBatch.from_pydict({m: [w] for m, w in zip(names, row)})

    whole = df.select(F.col(x).cast(ARRAY).alias("x"), F.col(y).cast("double").alias("y")).where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    parts = whole.mapInArrow(sums, ", ".join(f"{m} double" for m in names))
    return parts.agg(F.sum("_n").cast("bigint").alias("_n"), *[F.sum(m).alias(m) for m in names[1:]])


def add_up(mom: DataFrame, keys: list[str], k: int, m: int) -> DataFrame:
    return mom.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in moment_columns(k, m)])


def _solver(k: int, m: int, ridge: float, penalise: tuple[bool, ...]):
    iu = pairs(k)
    pen = np.diag([ridge if p else 0.0 for p in penalise])

    @F.pandas_udf(ARRAY)
    def solve(g: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for gi, ci in zip(g, c):
            if gi is None or ci is None:
                out.append(None)
                continue
            a = np.zeros((k, k))
            for (i, j), v in zip(iu, gi):
                a[i, j] = a[j, i] = v
            b = np.asarray(ci, dtype=float).reshape(k, m)
            scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
            s = (a + pen) / np.outer(scale, scale)
            w = np.linalg.pinv(s, rcond=1e-13) @ (b / scale[:, None])
            out.append((w / scale[:, None]).ravel().tolist())
        return pd.Series(out)

    return solve


def solve(mom: DataFrame, k: int, m: int, ridge: float = 0.0, penalise: tuple[bool, ...] | None = None, name: str = "coef") -> DataFrame:
    """Add the k x m coefficients of (G + ridge) b = c as one array, row-major."""
    g = F.array(*[F.col(f"_g{i}_{j}") for i, j in pairs(k)])
    c = F.array(*[F.col(f"_c{i}_{j}") for i in range(k) for j in range(m)])
    return mom.withColumn(name, _solver(k, m, ridge, penalise or (True,) * k)(g, c))


def predict(coef: str, x: list[Column], m: int = 1, response: int = 0) -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(x):
        out = out + F.col(coef)[i * m + response] * c
    return out


def residual_variance(mom: str | None, coef: str, k: int, m: int = 1, response: int = 0) -> Column:
    """Population variance of the residuals from the moments alone (first regressor constant)."""
    b = [F.col(coef)[i * m + response] for i in range(k)]
    n = F.col("_n").cast("double")
    sse = F.col(f"_y{response}_{response}")
    mean = F.col(f"_c0_{response}")
    for i in range(k):
        sse = sse - 2.0 * b[i] * F.col(f"_c{i}_{response}")
        mean = mean - b[i] * F.col(f"_g0_{i}")
    for i, j in pairs(k):
        sse = sse + (1.0 if i == j else 2.0) * b[i] * b[j] * F.col(f"_g{i}_{j}")
    return F.greatest(sse / n - (mean / n) * (mean / n), F.lit(0.0))


def fit_log_linear(
    df: DataFrame, keys: list[str], x: list[Column], target: Column, training: Column, ridge: float = 0.0, penalise_first: bool = False
) -> DataFrame:
    """Coefficients of a log target per key with the lognormal retransformation factor."""
    k = len(x)
    mom = moments(df.where(training & (target > 0)), keys, x, [F.log(target)])
    pen = (penalise_first,) + (True,) * (k - 1)
    fit = solve(mom, k, 1, ridge, pen)
    return fit.withColumn("smearing", F.exp(0.5 * residual_variance(None, "coef", k))).select(*keys, "coef", "smearing", F.col("_n").alias("train_rows"))


def predict_level(x: list[Column]) -> Column:
    return F.exp(predict("coef", x)) * F.col("smearing")


def positive_glm(
    df: DataFrame, keys: list[str], x: list[Column], target: Column, training: Column, power: float = 2.0, alpha: float = 1e-4,
    steps: int = 40, tolerance: float = 1e-11, each: Column | None = None,
) -> DataFrame:
    """Log-link GLM with variance mu^power (2 gamma, between 1 and 2 Tweedie) for all keys at once.

    Minimises the mean half deviance plus alpha / 2 times the squared coefficients, every one of
    them.  Each step is one weighted least-squares aggregate over the training rows: weights are the
    second derivatives of the deviance and the working response is the Newton step's, from a
    start on the log target.  A table of one row per key (coefficients and largest score) is all
    that passes between steps; keys that have converged keep their coefficients.  Returns
    ``keys, coef, steps, score, train_rows``, where score is the largest absolute score equation.
    ``each`` is an array of structs whose fields (keys, masks) multiply the rows of a written frame anew
    in every pass.
    """
    from ..sources.results import materialise

    k = len(x)
    rows = df.where(training & target.isNotNull())
    if each is not None:
        rows = rows.withColumn("_each", F.explode(each)).select(*df.columns, "_each.*")
    rows = rows.select(*keys, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)], floored(target, VARIANCE_FLOOR).alias("_t"))
    rows = rows.dropna(subset=[f"_x{i}" for i in range(k)])
    if each is None:
        rows = materialise(rows)
    xs = [F.col(f"_x{i}") for i in range(k)]

    def solved(mom: DataFrame) -> DataFrame:
        return solve(mom.withColumns({f"_g{i}_{i}": F.col(f"_g{i}_{i}") + alpha * F.col("_n") for i in range(k)}), k, 1)

    def beside(fits: DataFrame, few: bool) -> DataFrame:
        """Rows with the coefficients of their key; few keys are broadcast, as a shuffle would put a key's rows into one task."""
        fits = fits.select(*keys, "coef")
        return rows.join(F.broadcast(fits) if few else fits, keys) if keys else with_scalars(rows, fits)

    state = materialise(solved(moments(rows, keys, xs, [F.log("_t")])).select(*keys, "coef", F.lit(0).alias("steps"), F.lit(float("inf")).alias("score"), F.col("_n").alias("train_rows")))
    few = state.count() <= FEW
    for _ in range(steps):
        eta = predict("coef", xs)
        slope = (F.col("_t") - F.exp("_eta")) * F.exp((1.0 - power) * F.col("_eta"))
        curve = (2.0 - power) * F.exp((2.0 - power) * F.col("_eta")) + (power - 1.0) * F.col("_t") * F.exp((1.0 - power) * F.col("_eta"))
        placed = beside(state, few).withColumn("_eta", eta)
        placed = placed.withColumns({"_s": slope, "_h": curve}).withColumn("_d", F.col("_s") / F.col("_h"))
        mom = moments(placed, keys, xs, [F.col("_eta") + F.col("_d"), F.col("_d")], F.col("_h"))  # the second response's products are the score
        both = solved(mom).withColumnRenamed("coef", "_new")
        both = both.join(state, keys) if keys else with_scalars(both, state)
        score = F.greatest(*[F.abs(F.col(f"_c{i}_1") / F.col("_n") - alpha * F.col("coef")[i]) for i in range(k)], F.lit(0.0))
        both = both.withColumn("_score", score)
        done = F.col("_score") <= tolerance
        state = materialise(both.select(
            *keys, F.when(done, F.col("coef")).otherwise(F.col("_new")).alias("coef"), (F.col("steps") + F.when(done, 0).otherwise(1)).alias("steps"),
            F.col("_score").alias("score"), "train_rows"))
        if state.where(F.col("score") > tolerance).limit(1).count() == 0:
            break
    return state


def elastic_net_path(mom: DataFrame, keys: list[str], k: int, alphas: list[float], l1: float = 0.5, sweeps: int = 10_000, tolerance: float = 1e-12) -> DataFrame:
    """Elastic-net coefficients per key and penalty from moments alone: ``keys, alpha, coef``.

    The first regressor is the constant and carries no penalty.  Minimises the mean squared error
    over two plus alpha times (l1 times the absolute coefficients plus (1 - l1) / 2 times their
    squares), by coordinate descent on the centred moment matrix.  Penalties are taken from the
    largest down, each from where the one before ended; no penalty reads a row of data.
    """
    order = sorted({float(a) for a in alphas}, reverse=True)
    iu = pairs(k)

    @F.pandas_udf(T.ArrayType(ARRAY))
    def descend(n: pd.Series, g: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for ni, gi, ci in zip(n, g, c):
            a = np.zeros((k, k))
            for (i, j), v in zip(iu, gi):
                a[i, j] = a[j, i] = v / ni
            b = np.asarray(ci, float) / ni
            means, mean = a[0, 1:], b[0]
            cov, cross = a[1:, 1:] - np.outer(means, means), b[1:] - means * mean
            w, fits = np.zeros(k - 1), []
            for alpha in order:
                for _ in range(sweeps):
                    moved = 0.0
                    for i in range(k - 1):
                        pull = cross[i] - cov[i] @ w + cov[i, i] * w[i]
                        new = np.sign(pull) * max(abs(pull) - alpha * l1, 0.0) / max(cov[i, i] + alpha * (1 - l1), 1e-300)
                        moved, w[i] = max(moved, abs(new - w[i])), new
                    if moved <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
                        break
                fits.append([float(mean - means @ w), *w.tolist()])
            out.append(fits)
        return pd.Series(out)

    g = F.array(*[F.col(f"_g{i}_{j}") for i, j in iu])
    fits = descend(F.col("_n").cast("double"), g, F.array(*[F.col(f"_c{i}_0") for i in range(k)]))
    path = mom.withColumn("_f", fits).select("*", F.posexplode("_f").alias("_p", "coef"))
    return path.withColumn("alpha", F.array(*[F.lit(a) for a in order])[F.col("_p")]).drop("_f", "_p")


def masked(features: list[Column]) -> list[Column]:
    """A constant, the features with zero for what is missing or not finite, and their missing flags.

    A fill with any value v is linear in these columns (feature + v * flag), so the moments of a
    design imputed and scaled by the statistics of any fold follow from theirs without the rows.
    """
    x = [finite(c.cast("double")) for c in features]
    return [F.lit(1.0), *[F.coalesce(c, F.lit(0.0)) for c in x], *[F.when(c.isNull(), 1.0).otherwise(0.0) for c in x]]


def solve_imputed(mom: DataFrame, k: int, m: int, fills: list[Column], ridge: float = 0.0, name: str = "coef") -> DataFrame:
    """Ridge fits on imputed, standardised features with flags, from moments of :func:`masked` columns.

    ``k`` features; ``fills`` holds what stands in for a missing value of each, per row of ``mom``.
    Means, deviations and flags (only of features that miss in these moments) are of the filled
    columns.  The coefficients are over the masked columns, row-major.  Null where there are no more rows
    than columns or a feature is wholly missing.
    """
    size, iu = 1 + 2 * k, pairs(1 + 2 * k)

    @F.pandas_udf(ARRAY)
    def fit(n: pd.Series, g: pd.Series, c: pd.Series, fill: pd.Series) -> pd.Series:
        out = []
        for ni, gi, ci, fi in zip(n, g, c, fill):
            u = np.zeros((size, size))
            for (i, j), v in zip(iu, gi):
                u[i, j] = u[j, i] = v
            b = np.asarray(ci, float).reshape(size, m)
            fi = np.array([np.nan if v is None else v for v in fi], float)
            gone = u[0, 1 + k:]
            if ((gone > 0) & ~np.isfinite(fi)).any():
                out.append(None)
                continue
            basis = [np.eye(size)[0]]
            for a in range(k):
                d = np.eye(size)[1 + a] + (fi[a] if gone[a] > 0 else 0.0) * np.eye(size)[1 + k + a]
                mean = u[0] @ d / ni
                spread = np.sqrt(max(d @ u @ d / ni - mean * mean, 0.0))
                basis.append((d - mean * basis[0]) / (spread if spread > max(1e-12, 1e-7 * abs(mean)) else 1.0))
            basis += [np.eye(size)[1 + k + a] for a in range(k) if gone[a] > 0]
            a = np.stack(basis, axis=1)
            if ni <= a.shape[1]:
                out.append(None)
                continue
            w = np.linalg.pinv(a.T @ u @ a + ridge * np.eye(a.shape[1]), rcond=1e-15) @ (a.T @ b)
            out.append((a @ w).ravel().tolist())
        return pd.Series(out, dtype=object)

    g = F.array(*[F.col(f"_g{i}_{j}") for i, j in iu])
    c = F.array(*[F.col(f"_c{i}_{j}") for i in range(size) for j in range(m)])
    return mom.withColumn(name, fit(F.col("_n").cast("double"), g, c, F.array(*fills)))


def residual_moments(size: int, m: int):
    """Sums of products of the residuals of ``m`` responses, from moments over ``size`` regressors and coefficients."""
    gi, yi = pairs(size), pairs(m)

    @F.pandas_udf(ARRAY)
    def products(g: pd.Series, c: pd.Series, y: pd.Series, coef: pd.Series) -> pd.Series:
        if not len(g):
            return pd.Series([], dtype=object)
        n = len(g)
        u, v = np.zeros((n, size, size)), np.zeros((n, m, m))
        for full, iu, part in ((u, gi, g), (v, yi, y)):
            flat = np.stack(part.to_numpy())
            for at, (i, j) in enumerate(iu):
                full[:, i, j] = full[:, j, i] = flat[:, at]
        w = np.stack(c.to_numpy()).reshape(n, size, m)
        b = np.stack(coef.to_numpy()).reshape(n, size, m)
        cross = b.transpose(0, 2, 1) @ w
        e = v - cross - cross.transpose(0, 2, 1) + b.transpose(0, 2, 1) @ u @ b
        return pd.Series(list(e[:, [i for i, _ in yi], [j for _, j in yi]]))

    g = F.array(*[F.col(f"_g{i}_{j}") for i, j in gi])
    c = F.array(*[F.col(f"_c{i}_{j}") for i in range(size) for j in range(m)])
    return products(g, c, F.array(*[F.col(f"_y{i}_{j}") for i, j in yi]), F.col("coef"))


def double_ml(
    df: DataFrame, keys: list[str], response: Column | dict[str, Column], treatments: dict[str, Column], controls: list[Column], folds: int, purge: int = 1,
    ridge: float = 1e-6, session: str = "session_date",
) -> DataFrame:
    """Partialling-out with contiguous time folds, purge bands and session-clustered errors.

    A constant is added to the controls; one named among them adds nothing.  Missing controls are filled by the median of each fold's own
    training rows and flagged; rows leave only for a missing response or treatment.  Rows are read for
    two things: moments per session and medians, from counts per ordered bin and set of folds that train
    on it.  Nuisance fits are sums of session moments, and residuals enter the estimate and the
    covariance by their products summed per session, which follow from the same moments.

    ``response`` may name several, fitted on the same moments, each on the rows that have it; a
    column ``response`` then follows the keys.
    """
    from ..sources.results import materialise
    from .quantiles import window_quantiles

    responses = response if isinstance(response, dict) else {"": response}
    names, nr = list(treatments), len(responses)
    k, m = len(controls), 1 + len(names)
    size, ks = 1 + 2 * k, [*keys, "_ri"]
    days = df.select(session).where(F.col(session).isNotNull()).distinct().withColumns({
        "session_index": (F.row_number().over(Window.orderBy(session)) - 1).cast("bigint"), "_s": F.count(F.lit(1)).over(Window.partitionBy())})
    small, big, i = F.floor(F.col("_s") / folds), F.col("_s") % folds, F.col("session_index")
    begin = lambda f: f * small + F.least(f, big)
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(folds - 1).cast("bigint"))
    days = materialise(days.select(
        session, "session_index", F.filter(every, lambda f: (i >= begin(f)) & (i <= begin(f + 1) - 1))[0].alias("fold"),
        F.filter(every, lambda f: (i < begin(f) - purge) | (i > begin(f + 1) - 1 + purge)).alias("_t")))
    days = F.broadcast(days) if days.count() <= FEW else days
    every_y = [finite(c.cast("double")) for c in (*responses.values(), *treatments.values())]
    work = df.join(days, session).select(
        *keys, "session_index", "fold", "_t", *[c.alias(f"_x{a}") for a, c in enumerate(masked(controls))], *[c.alias(f"_r{a}") for a, c in enumerate(every_y)])
    work = work.dropna(subset=[f"_r{a}" for a in range(nr, nr + m - 1)])
    held = F.filter(F.array(*[F.when(F.col(f"_r{a}").isNotNull(), F.lit(a)) for a in range(nr)]), lambda a: a.isNotNull())
    work = work.withColumn("_p", held).where(F.size("_p") > 0)
    work = materialise(work.withColumns({f"_r{a}": F.coalesce(f"_r{a}", F.lit(0.0)) for a in range(nr)}))
    xs = [F.col(f"_x{a}") for a in range(size)]
    each = moments(work, [*keys, "_p", "session_index", "fold", "_t"], xs, [F.col(f"_r{a}") for a in range(nr + m - 1)])
    own = lambda name: F.array(*[F.col(name(r)) for r in range(nr)])[F.col("_ri")]
    ts = range(1, m)
    each = each.withColumn("_ri", F.explode("_p")).select(
        *ks, "session_index", "fold", "_t", "_n", *[f"_g{a}_{b}" for a, b in pairs(size)],
        *[own(lambda r, a=a: f"_c{a}_{r}").alias(f"_c{a}_0") for a in range(size)], *[F.col(f"_c{a}_{nr + t - 1}").alias(f"_c{a}_{t}") for a in range(size) for t in ts],
        own(lambda r: f"_y{r}_{r}").alias("_y0_0"), *[own(lambda r, t=t: f"_y{r}_{nr + t - 1}").alias(f"_y0_{t}") for t in ts],
        *[F.col(f"_y{nr + t - 1}_{nr + u - 1}").alias(f"_y{t}_{u}") for t in ts for u in range(t, m)])
    per_session = materialise(add_up(each, [*ks, "session_index", "fold", "_t"], size, m))
    fitted = add_up(per_session.withColumn("fold", F.explode("_t")), [*ks, "fold"], size, m)
    if k:
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("_k"), F.when(xs[1 + k + a] == 0, xs[1 + a]).alias("_v")) for a in range(k)]))
        long = work.select(*keys, "_p", "_t", each.alias("_e")).select(*keys, "_p", "_t", "_e._k", "_e._v")
        widen = lambda x: x.withColumn("_ri", F.explode("_p")).withColumn("fold", F.explode("_t"))
        medians = window_quantiles(long, [*keys, "_p", "_t", "_k"], [*ks, "fold", "_k"], widen, F.col("_v"), {"_q": 0.5}, 256, FEW).groupBy(*ks, "fold").agg(
            *[F.max(F.when(F.col("_k") == a, F.col("_q"))).alias(f"_f{a}") for a in range(k)])
        fitted = fitted.join(medians, [*ks, "fold"], "left")
    fills = [F.col(f"_f{a}") for a in range(k)] or [F.lit(None).cast("double")]
    coef = materialise(solve_imputed(fitted, k, m, fills, ridge).where(F.col("coef").isNotNull()).select(*ks, "fold", "coef"))
    res = per_session.join(coef, [*ks, "fold"]).withColumn("_e", residual_moments(size, m)).select(
        *ks, "session_index", "_n", *[F.col("_e")[at].alias(f"_e{a}_{b}") for at, (a, b) in enumerate(pairs(m))])
    res = materialise(res)
    q = m - 1
    stage = res.groupBy(*ks).agg(
        F.sum("_n").alias("_n"), *[F.sum(f"_e{a + 1}_{b + 1}").alias(f"_g{a}_{b}") for a, b in pairs(q)], *[F.sum(f"_e0_{a + 1}").alias(f"_c{a}_0") for a in range(q)])
    stage = solve(stage, q, 1, name="theta")
    score = res.join(stage.select(*ks, "theta"), ks)
    pair = lambda a, b: F.col(f"_e{min(a, b)}_{max(a, b)}")
    u = [pair(0, a) - predict("theta", [pair(a, b) for b in ts]) for a in ts]
    meat = score.withColumns({f"_u{a}": c for a, c in enumerate(u)}).groupBy(*ks).agg(
        F.count(F.lit(1)).alias("clusters"), *[F.sum(F.col(f"_u{a}") * F.col(f"_u{b}")).alias(f"_m{a}_{b}") for a, b in pairs(q)])
    j = stage.join(meat, ks)
    iu = pairs(q)

    @F.pandas_udf(ARRAY)
    def sandwich(g: pd.Series, mt: pd.Series, th: pd.Series, cl: pd.Series, nr: pd.Series) -> pd.Series:
        out = []
        for gi, mi, ti, ci, ni in zip(g, mt, th, cl, nr):
            a, b = np.zeros((q, q)), np.zeros((q, q))
            for (r, s), v, w in zip(iu, gi, mi):
                a[r, s] = a[s, r] = v
                b[r, s] = b[s, r] = w
            inv = np.linalg.pinv(a)
            cov = inv @ b @ inv * (ci / max(ci - 1, 1)) * ((ni - 1) / max(ni - q, 1))
            t = np.asarray(ti, dtype=float)
            out.append([float(t @ np.linalg.pinv(cov) @ t), *np.sqrt(np.maximum(np.diag(cov), 0.0)).tolist()])
        return pd.Series(out)

    g = F.array(*[F.col(f"_g{a}_{b}") for a, b in iu])
    mm = F.array(*[F.col(f"_m{a}_{b}") for a, b in iu])
    out = j.withColumn("_s", sandwich(g, mm, F.col("theta"), F.col("clusters").cast("double"), F.col("_n").cast("double")))
    rows = F.explode(F.array(*[F.struct(
        F.lit(nm).alias("treatment"), F.col("theta")[a].alias("theta"), F.col("_s")[a + 1].alias("se")) for a, nm in enumerate(names)]))
    named = [F.array(*[F.lit(n) for n in responses])[F.col("_ri")].alias("response")] if isinstance(response, dict) else []
    out = out.withColumn("_r", rows).select(
        *keys, *named, "_r.*", "clusters", F.col("_n").alias("rows"), F.col("_s")[0].alias("joint_wald"))
    t = F.when(F.col("se") > 0, F.col("theta") / F.col("se"))
    return out.withColumn("t_statistic", t).withColumn("p_value", t_two_sided(F.col("t_statistic"), F.col("clusters") - 1)).withColumn(
        "joint_p", chi2_sf(F.col("joint_wald"), q))
