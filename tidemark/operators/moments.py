"""Regression by moment sums: one aggregation pass, then a k x k solve on the driver.

What reaches the driver is one row of k^2 sums (per group where groups are declared and few),
never data rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def gram_columns(x: list[Column], y: list[Column], where: Column | None = None, tag: str = "") -> list[Column]:
    """Aggregate columns of X'X (upper triangle), X'Y, Y'Y and n, limited to ``where``."""
    def s(c: Column) -> Column:
        return F.sum(c if where is None else F.when(where, c))

    out = [(F.count(F.lit(1)) if where is None else F.count_if(where)).alias(f"{tag}n")]
    for i, a in enumerate(x):
        out += [s(a * b).alias(f"{tag}x{i}_{j}") for j, b in enumerate(x) if j >= i]
        out += [s(a * b).alias(f"{tag}xy{i}_{j}") for j, b in enumerate(y)]
    out += [s(a * b).alias(f"{tag}yy{i}_{j}") for i, a in enumerate(y) for j, b in enumerate(y) if j >= i]
    return out


def gram_of(row: Row, k: int, m: int, tag: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The sums of one row as (X'X, X'Y, Y'Y, n)."""
    g, c, yy = np.zeros((k, k)), np.zeros((k, m)), np.zeros((m, m))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"{tag}x{i}_{j}"] or 0.0
        for j in range(m):
            c[i, j] = row[f"{tag}xy{i}_{j}"] or 0.0
    for i in range(m):
        for j in range(i, m):
            yy[i, j] = yy[j, i] = row[f"{tag}yy{i}_{j}"] or 0.0
    return g, c, yy, int(row[f"{tag}n"])


def with_intercept(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f).cast("double") for f in features]]


def linear(coefs: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(coefs[0]))
    for b, f in zip(coefs[1:], features):
        out = out + float(b) * F.col(f)
    return out


def conditioning(df: DataFrame, features: list[str]) -> DataFrame:
    """Rank and condition number of the standardised columns, from their correlation matrix."""
    x = [F.col(f).cast("double") for f in features]
    whole = F.lit(True)
    for c in x:
        whole = whole & c.isNotNull()
    row = df.where(whole).agg(*gram_columns([F.lit(1.0), *x], [])).collect()[0]
    g, _, _, n = gram_of(row, len(x) + 1, 0)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    keep = sd > np.maximum(np.abs(mean) * 1e-12, 1e-15)
    corr = cov[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep])
    eig = np.linalg.eigvalsh(corr) if keep.any() else np.zeros(0)
    rank = int((eig > eig.max() * len(eig) * 1e-12).sum()) if eig.size else 0
    cond = float(np.sqrt(eig.max() / eig.min())) if eig.size and eig.min() > 0 else None
    return df.sparkSession.createDataFrame(
        [(len(features), n, int((~keep).sum()), rank, rank < len(features), cond)],
        "feature_count bigint, complete_rows bigint, zero_variance bigint, matrix_rank bigint, rank_deficient boolean, condition_number double")
