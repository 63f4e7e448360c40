"""GARCH(1,1) by quasi maximum likelihood for many keys at once.

h <- omega + alpha r^2 + beta h is affine in h, and so are its derivatives by the parameters.  A
session therefore maps its entering variance and derivatives to its leaving ones with a few numbers.
A pass of the fit is: these numbers per session, one fold over the sessions of a key, and one sum per
key of likelihood, score and information over all sessions, each from its own start.  The first step is
a scoring step; later ones correct the curvature by how the score changed.  A pass tries several lengths
of a step side by side and keeps the best, so there is no line search of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.results import materialise

SCALE = 1e4  # returns are fitted in these units, as their variances are tiny
FLOOR = 1e-10
MOST_PERSISTENT = 0.999
LENGTHS = (1.0, 2.0, 0.3, 0.05)
STARTS = ((0.08, 0.90), (0.05, 0.70), (0.15, 0.60), (0.10, 0.30))  # alpha, beta; the likeliest is gone on from
NEAR = 1e-10  # score against curvature: twice what the likelihood could still gain
STATE = "u array<double>, nll double, score array<double>, curvature array<double>, length double, tries array<array<double>>, decrement double, quiet int, done boolean, passes int"


def _shares(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much of the most persistent a point (..., 3) has, and the part of alpha in it."""
    return tuple(1.0 / (1.0 + np.exp(-u[..., i])) for i in (1, 2))


def _parameters(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha, beta of points (..., 3): log of omega, logits of persistence and of alpha's part; all are stationary."""
    whole, part = _shares(u)
    return np.exp(u[..., 0]), MOST_PERSISTENT * whole * part, MOST_PERSISTENT * whole * (1.0 - part)


def _logit(x: float) -> float:
    return math.log(x / (1.0 - x))


def _batch(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared returns padded to (sessions, longest), lengths, and points (sessions, tries, 3) of a batch."""
    sizes = pdf["_r"].map(len).to_numpy()
    squares = np.zeros((len(pdf), int(sizes.max())))
    for i, r in enumerate(pdf["_r"]):
        squares[i, : len(r)] = np.square(r)
    return squares, sizes, np.stack([np.stack(t) for t in pdf["tries"]])


def _maps(keys: list[str], session: str):
    """Per session: what it does to an entering variance and to its three derivatives, for every try."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            squares, sizes, tries = _batch(pdf)
            omega, alpha, beta = _parameters(tries)
            h, w, a, b = (np.zeros_like(omega) for _ in range(4))
            for i in range(squares.shape[1]):
                live, x = (i < sizes)[:, None], squares[:, i, None]
                b = np.where(live, h + beta * b, b)
                a = np.where(live, x + beta * a, a)
                w = np.where(live, 1.0 + beta * w, w)
                h = np.where(live, omega + alpha * x + beta * h, h)
            n = sizes[:, None].astype(float)
            out = pdf[[*keys, session]].copy()
            for name, v in (("_h", h), ("_w", w), ("_a", a), ("_b", b), ("_p", beta**n), ("_d", n * beta ** (n - 1.0))):
                out[name] = list(v)
            out["tries"] = pdf["tries"]
            yield out
    return run


def _fold(keys: list[str], session: str):
    """Variance and derivatives that enter each session of a key; the row without a session holds what leaves the last."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(session)
        omega, alpha, beta = _parameters(np.stack(pdf["tries"].iloc[0]))
        room = np.maximum(1.0 - alpha - beta, 1e-6)
        h, w, a = omega / room, 1.0 / room, omega / room**2
        b, starts = a.copy(), []
        for row in pdf[["_h", "_w", "_a", "_b", "_p", "_d"]].itertuples(index=False):
            starts.append((h, w, a, b))
            mh, mw, ma, mb, p, d = row
            h, w, a, b = p * h + mh, p * w + mw, p * a + ma, p * b + d * h + mb
        starts.append((h, w, a, b))
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(starts) for k in keys})
        out[session] = [*pdf[session], None]
        for i, name in enumerate(("_h", "_w", "_a", "_b")):
            out[name] = [s[i] for s in starts]
        return out
    return run


def _sums(keys: list[str]):
    """Likelihood, score and information of each session and try, from its own start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            squares, sizes, tries = _batch(pdf)
            omega, alpha, beta = _parameters(tries)
            h, w, a, b = (np.stack(pdf[c].to_list()) for c in ("_h", "_w", "_a", "_b"))
            whole, part = _shares(tries)
            persistence = alpha + beta
            total = np.zeros((10, *omega.shape))
            for i in range(squares.shape[1]):
                live, x = (i < sizes)[:, None], squares[:, i, None]
                v = np.maximum(h, FLOOR)
                d = np.stack([w * omega, (part * a + (1.0 - part) * b) * persistence * (1.0 - whole), (a - b) * persistence * part * (1.0 - part)])
                total[0] += np.where(live, 0.5 * (np.log(v) + x / v), 0.0)
                total[1:4] += np.where(live, 0.5 * (1.0 - x / v) / v * d, 0.0)
                total[4:] += np.where(live, 0.5 / v**2 * np.stack([d[j] * d[k] for j in range(3) for k in range(j, 3)]), 0.0)
                w, a, b = 1.0 + beta * w, x + beta * a, h + beta * b
                h = omega + alpha * x + beta * h
            rows = pdf[keys].loc[pdf.index.repeat(omega.shape[1])].reset_index(drop=True)
            rows["_try"] = np.tile(np.arange(omega.shape[1]), len(pdf))
            for i in range(10):
                rows[f"_s{i}"] = total[i].reshape(-1)
            yield rows
    return run


def _next_tries(u: np.ndarray, score: np.ndarray, curvature: np.ndarray, length: float) -> list[np.ndarray]:
    """Points along the step from ``u``."""
    step = -np.linalg.lstsq(curvature, score, rcond=None)[0]
    step *= length * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-300))
    return [u + share * step for share in LENGTHS]


def _corrected(curvature: np.ndarray, moved: np.ndarray, change: np.ndarray) -> np.ndarray | None:
    """Curvature that explains the change of the score over a move; none where it would not be positive."""
    along = float(moved @ change)
    if along <= 1e-10 * float(np.linalg.norm(moved) * np.linalg.norm(change)):
        return None
    pushed = curvature @ moved
    return curvature - np.outer(pushed, pushed) / float(moved @ pushed) + np.outer(change, change) / along


def _advance(keys: list[str]):
    """The state of each key after a pass: the best try if it is better, and the next tries."""
    def one(row) -> dict:
        totals = sorted(([t[f] for f in ("_try", *[f"_s{i}" for i in range(10)])] for t in row["_totals"]), key=lambda t: (t[1] if math.isfinite(t[1]) else math.inf, t[0]))
        best, u, nll = totals[0], np.array(row["u"]), row["nll"]
        better = math.isfinite(best[1]) and best[1] < nll
        gain = nll - best[1] if better else 0.0
        score, curvature = np.array(row["score"]), np.array(row["curvature"]).reshape(-1, 3)
        if better:
            new, upper = np.array(row["tries"][int(best[0])]), np.array(best[5:])
            info = np.array([[upper[0], upper[1], upper[2]], [upper[1], upper[3], upper[4]], [upper[2], upper[4], upper[5]]])
            change = np.array(best[2:5])
            fixed = _corrected(curvature, new - u, change - score) if score.size else None
            u, nll, score, curvature = new, best[1], change, info if fixed is None else fixed
        length = 1.0 if better else row["length"] / 100.0
        decrement = float(score @ np.linalg.lstsq(curvature, score, rcond=None)[0])
        quiet = row["quiet"] + 1 if gain <= 1e-13 * max(1.0, abs(nll)) else 0
        return {
            "u": u, "nll": nll, "score": score, "curvature": curvature.reshape(-1), "length": length, "tries": _next_tries(u, score, curvature, length),
            "decrement": decrement, "quiet": quiet, "done": decrement < NEAR or quiet >= 3, "passes": row["passes"] + 1}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = pd.DataFrame([one(row) for row in pdf.to_dict("records")], columns=[f.split()[0] for f in STATE.split(", ")])
            yield pd.concat([pdf[keys].reset_index(drop=True), new], axis=1)
    return run


def garch_fit(
    returns: DataFrame, keys: list[str], session: str, order: str, r: str, horizon: int, most_passes: int = 40, at_least: int = 100
) -> DataFrame:
    """One row per key: omega, alpha, beta, nll (per scaled return), the next variance and the forecast summed over ``horizon``.

    ``status`` is converged, stalled (no try improves and the score is not zero), passes (none left), short (under ``at_least`` returns) or flat (no variance);
    the estimates of the last two are null.  Rows without a return or session do not count.  Returns tie by
    value where ``order`` ties.  Keys must not be null; a task holds one session, or one row per session of a key.
    """
    clean = returns.where(F.col(r).isNotNull() & ~F.isnan(F.col(r).cast("double")) & F.col(session).isNotNull()).withColumn("_x", F.col(r).cast("double") * SCALE)
    size = materialise(clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.var_pop("_x").alias("_var")))
    reason = F.when(F.col("observations") < at_least, "short").when(~(F.col("_var") > 0), "flat")
    fitted = size.where(reason.isNull())
    row = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_x").alias("x"))))
    sessions = materialise(clean.join(fitted.select(*keys), keys, "left_semi").groupBy(*keys, session).agg(row.alias("_r")).withColumn("_r", F.transform("_r", lambda p: p["x"])))
    types = dict(returns.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    four = ", ".join(f"{c} array<double>" for c in ("_h", "_w", "_a", "_b"))

    def starts(points: DataFrame) -> DataFrame:
        maps = sessions.join(points.select(*keys, "tries"), keys).mapInPandas(
            _maps(keys, session), f"{named}, `{session}` {types[session]}, {four}, _p array<double>, _d array<double>, tries array<array<double>>")
        return maps.groupBy(*keys).applyInPandas(_fold(keys, session), f"{named}, `{session}` {types[session]}, {four}")

    def start(alpha: float, beta: float):
        p = alpha + beta
        return F.array(F.log(F.greatest("_var", F.lit(1e-8)) * (1.0 - p)), F.lit(_logit(p / MOST_PERSISTENT)), F.lit(_logit(alpha / p)))

    none = F.array().cast("array<double>")
    state = materialise(fitted.select(
        *keys, start(*STARTS[0]).alias("u"), F.lit(math.inf).alias("nll"), none.alias("score"), none.alias("curvature"), F.lit(1.0).alias("length"), F.array(*[start(*x) for x in STARTS]).alias("tries"),
        F.lit(math.inf).alias("decrement"), F.lit(0).alias("quiet"), F.lit(False).alias("done"), F.lit(0).alias("passes")))
    for _ in range(most_passes):
        open_keys = state.where(~F.col("done"))
        if open_keys.isEmpty():
            break
        sums = sessions.join(open_keys.select(*keys, "tries"), keys).join(starts(open_keys), [*keys, session]).mapInPandas(
            _sums(keys), f"{named}, _try bigint, {', '.join(f'_s{i} double' for i in range(10))}")
        totals = sums.groupBy(*keys, "_try").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(10)]).groupBy(*keys).agg(
            F.collect_list(F.struct("_try", *[f"_s{i}" for i in range(10)])).alias("_totals"))
        moved = open_keys.join(totals, keys).mapInPandas(_advance(keys), f"{named}, {STATE}")
        state = materialise(moved.unionByName(state.where("done")))
    last = starts(state.withColumn("tries", F.array("u"))).where(F.col(session).isNull()).select(*keys, (F.col("_h")[0] / SCALE**2).alias("next_variance"))
    logistic = lambda x: 1.0 / (1.0 + F.exp(-x))
    whole, part = MOST_PERSISTENT * logistic(F.col("u")[1]), logistic(F.col("u")[2])
    out = size.join(state, keys, "left").join(last, keys, "left").withColumns({
        "omega": F.exp(F.col("u")[0]) / SCALE**2, "alpha": whole * part, "beta": whole * (1.0 - part)})
    p = F.col("alpha") + F.col("beta")
    level = F.col("omega") / F.greatest(1.0 - p, F.lit(1e-6))
    geo = (1.0 - F.pow(p, F.lit(float(horizon)))) / (1.0 - p)
    return out.select(
        *keys, "observations", "omega", "alpha", "beta", "nll", "decrement", level.alias("variance"), "next_variance",
        (horizon * level + geo * (F.col("next_variance") - level)).alias("forecast"), "passes",
        F.coalesce(reason, F.when(F.col("decrement") < NEAR, "converged").when(F.col("done"), "stalled").otherwise("passes")).alias("status"))
