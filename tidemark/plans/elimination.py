"""Check SQL for linear fits: normal equations and their elimination, written out as CTEs."""

from __future__ import annotations


def fit_sql(name: str, src: str, keys: list[str], x: list[str], y: str, ridge: str = "0", weight: str = "", every: str = "") -> str:
    """CTEs up to ``name(keys, b0, b1, ...)``: (weighted) least squares of y on a constant and x, per key.

    ``ridge`` (a number or a column of the keys) is added to the diagonal but for the constant;
    ``every`` is an aggregate that is added to all of it.
    """
    by, more = f"*({weight})" if weight else "", f" + {every}" if every else ""
    k, cols = len(x) + 1, ["1.0::DOUBLE", *x]
    head = "".join(f"{c}, " for c in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    sums = [f"sum(({cols[i]})*({cols[j]}){by}) + {f'max({ridge})' if i == j and i else '0'}{more if i == j else ''} AS g{i}_{j}" for i in range(k) for j in range(i, k)]
    sums += [f"sum(({cols[i]})*({y}){by}) AS c{i}" for i in range(k)]
    out = [f"{name}_0 AS (SELECT {head}{', '.join(sums)} FROM {src}{group})"]
    for s in range(k - 1):
        kept = [f"g{i}_{j}" for i in range(s + 1) for j in range(i, k)] + [f"c{i}" for i in range(s + 1)]
        low = [f"g{i}_{j} - g{s}_{i}*g{s}_{j}/g{s}_{s} AS g{i}_{j}" for i in range(s + 1, k) for j in range(i, k)]
        low += [f"c{i} - g{s}_{i}*c{s}/g{s}_{s} AS c{i}" for i in range(s + 1, k)]
        out.append(f"{name}_{s + 1} AS (SELECT {head}{', '.join(kept + low)} FROM {name}_{s})")
    last = f"{name}_{k - 1}"
    for i in range(k - 1, -1, -1):
        known = "".join(f" - g{i}_{j}*b{j}" for j in range(i + 1, k))
        out.append(f"{name}{f'_b{i}' if i else ''} AS (SELECT *, (c{i}{known})/g{i}_{i} AS b{i} FROM {last})")
        last = f"{name}_b{i}"
    return ",\n ".join(out)


def glm_sql(name: str, src: str, keys: list[str], x: list[str], power: str, alpha: float = 1e-4, steps: int = 12) -> str:
    """CTEs up to ``name``: log-link GLM of ``target`` with variance mu^power, by Newton steps written out."""
    every, using = f"{alpha!r}::DOUBLE*count(*)", f"JOIN {{}} f USING ({', '.join(keys)})" if keys else ", {} f"
    y, p = "greatest(target,1e-12)", f"({power})"
    out, last = [fit_sql(f"{name}s0", src, keys, x, f"ln({y})", every=every)], f"{name}s0"
    for k in range(1, steps + 1):
        this = name if k == steps else f"{name}s{k}"
        out.append(f"{name}e{k} AS (SELECT s.*, {predicted(x, 'f.')} AS eta FROM {src} s {using.format(last)})")
        out.append(f"{name}w{k} AS (SELECT *, ({y}-exp(eta))*exp((1-{p})*eta) AS up, (2-{p})*exp((2-{p})*eta)+({p}-1)*{y}*exp((1-{p})*eta) AS curve FROM {name}e{k})")
        out.append(fit_sql(this, f"{name}w{k}", keys, x, "eta+up/curve", weight="curve", every=every))
        last = this
    return ",\n ".join(out)


def predicted(x: list[str], of: str = "") -> str:
    """The fitted value, with the coefficients of ``of`` (a table with its dot, or nothing)."""
    return "(" + "+".join([f"{of}b0", *[f"{of}b{i + 1}*({c})" for i, c in enumerate(x)]]) + ")"


def qlike_sql(target: str, forecast: str) -> str:
    ratio = f"({target}/greatest({forecast},1e-12))"
    return f"({ratio}-ln({ratio})-1)"
