"""Linear models on distributed sufficient statistics.

Facts are only summed (partial aggregation before the shuffle); every solve works
on one row of sums per group. Up to two regressors are solved in closed form as
Column expressions, any number by a vectorised UDF over the rows of sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-10


def safe(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def complete(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which none of the columns is null or NaN."""
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def moments(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """n, means, and centred sums s_ij of the columns xs + [y] per group, in one pass.

    Centred sums come from covar_samp, which updates means as it goes and so
    keeps its digits where means are large against deviations.
    """
    cols = [*xs, y]
    df = complete(df, *cols)
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in cols)]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            cov = F.var_samp(a) if a == b else F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double"))
            aggs.append((cov * (F.count(F.lit(1)) - 1)).alias(f"s_{a}_{b}"))
    return df.groupBy(*keys).agg(*aggs)


def ols_simple(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Intercept, slope, standard error, t, R2, F and dof of y on x per group."""
    m = moments(df, keys, [x], y)
    sxx, sxy, syy, n = (F.col(c) for c in (f"s_{x}_{x}", f"s_{x}_{y}", f"s_{y}_{y}", "n"))
    slope = safe(sxy, sxx)
    ssr = F.greatest(syy - slope * sxy, F.lit(0.0))
    dof = F.greatest(n - 2, F.lit(1))
    se = F.sqrt(ssr / dof / sxx)
    t = slope / (se + TINY)
    return m.where((n >= 3) & (sxx > 0)).select(*keys, n.alias("n"), (F.col(f"m_{y}") - slope * F.col(f"m_{x}")).alias("intercept"), slope.alias("slope"), se.alias("se"), t.alias("t"), F.when(syy <= TINY, 0.0).otherwise(1 - ssr / syy).alias("r2"), (t * t).alias("f"), dof.cast("long").alias("dof"))


def ols_two(df: DataFrame, keys: list[str], x1: str, x2: str, y: str) -> DataFrame:
    """Slopes, t values, partial R2 of each regressor, and R2, of y on x1 and x2 per group."""
    m = moments(df, keys, [x1, x2], y)
    a, b, c = F.col(f"s_{x1}_{x1}"), F.col(f"s_{x1}_{x2}"), F.col(f"s_{x2}_{x2}")
    p, q, yy, n = F.col(f"s_{x1}_{y}"), F.col(f"s_{x2}_{y}"), F.col(f"s_{y}_{y}"), F.col("n")
    det = a * c - b * b
    b1, b2 = safe(c * p - b * q, det), safe(a * q - b * p, det)
    ssr = F.greatest(yy - b1 * p - b2 * q, F.lit(0.0))
    dof = F.greatest(n - 3, F.lit(1))
    s2 = ssr / dof
    t1, t2 = b1 / (F.sqrt(s2 * c / det) + TINY), b2 / (F.sqrt(s2 * a / det) + TINY)
    part = lambda t: t * t / (t * t + dof)
    return m.where((n >= 4) & (det > 0)).select(*keys, n.alias("n"), b1.alias("b1"), b2.alias("b2"), t1.alias("t1"), t2.alias("t2"), part(t1).alias("partial_r2_1"), part(t2).alias("partial_r2_2"), F.when(yy <= TINY, 0.0).otherwise(1 - ssr / yy).alias("r2"))


def ols(df: DataFrame, keys: list[str], xs: list[str], y: str, contrasts: dict[str, list[float]] | None = None) -> DataFrame:
    """Any number of regressors and an intercept: beta, t, R2, and t of contrasts on the regressors, per group.

    Sums are aggregated by Spark; a UDF solves batches of groups. Rank-deficient
    designs get the minimum-norm solution.
    """
    p = len(xs)
    m = moments(df, keys, xs, y)
    sums = [f"s_{a}_{b}" for i, a in enumerate([*xs, y]) for b in [*xs, y][i:]]
    rows = np.array(list((contrasts or {}).values()), float).reshape(-1, p)

    @F.pandas_udf("beta array<double>, t array<double>, contrast_t array<double>, r2 double, dof long")
    def solve(n: pd.Series, s: pd.Series) -> pd.DataFrame:
        flat = np.stack(s.to_numpy()) if len(s) else np.zeros((0, len(sums)))
        full = np.zeros((len(flat), p + 1, p + 1))
        i, j = np.triu_indices(p + 1)
        full[:, i, j] = full[:, j, i] = np.nan_to_num(flat)
        inv = np.linalg.pinv(full[:, :p, :p], hermitian=True)
        xy, yy = full[:, :p, p], full[:, p, p]
        beta = np.einsum("nij,nj->ni", inv, xy)
        ssr = np.maximum(yy - np.einsum("ni,ni->n", beta, xy), 0)
        dof = np.maximum(n.to_numpy() - p - 1, 1)
        s2 = ssr / dof
        t = beta / (np.sqrt(np.maximum(s2[:, None] * np.einsum("nii->ni", inv), 0)) + TINY)
        est = beta @ rows.T
        ct = est / (np.sqrt(np.maximum(s2[:, None] * np.einsum("ci,nij,cj->nc", rows, inv, rows), 0)) + TINY)
        r2 = np.where(yy <= TINY, 0.0, 1 - ssr / np.where(yy <= TINY, 1, yy))
        return pd.DataFrame({"beta": list(beta), "t": list(t), "contrast_t": list(ct), "r2": r2, "dof": dof})

    return m.select(*keys, F.col("n"), solve(F.col("n"), F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in sums))).alias("fit")).select(*keys, "n", "fit.*")


def conjunction(*ts: Column) -> Column:
    """Signed minimum of t values: the least in size if all have one sign, else 0."""
    low, high = F.least(*ts), F.greatest(*ts)
    return F.when(low > 0, low).when(high < 0, high).otherwise(0.0)


def deming(df: DataFrame, keys: list[str], x: str, y: str, phi: float = 1.0) -> DataFrame:
    """Errors-in-variables slope and intercept; phi is the ratio of the errors' variances, y to x."""
    g = complete(df, x, y).groupBy(*keys).agg(F.var_samp(x).alias("sxx"), F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = F.col("syy") - phi * F.col("sxx")
    root = F.sqrt(d * d + 4 * phi * F.col("sxy") * F.col("sxy"))
    den = F.when(d >= 0, 2 * F.col("sxy")).otherwise(root - d)
    num = F.when(d >= 0, d + root).otherwise(2 * phi * F.col("sxy"))
    slope = F.when(F.abs(den) <= 1e-30, 0.0).otherwise(F.try_divide(num, den))
    return g.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def weighted_line(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted least squares line of y on x per group, by one pass of sums."""
    s = df.select(*keys, x.alias("_x"), y.alias("_y"), w.alias("_w")).groupBy(*keys).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("wx"), F.sum(F.col("_w") * F.col("_y")).alias("wy"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("wxx"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("wxy"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    det = F.when(F.abs(det) < 1e-12, 1e-12).otherwise(det)
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / det
    return s.select(*keys, slope.alias("slope"), ((F.col("wy") - slope * F.col("wx")) / F.col("w")).alias("intercept"))


def leave_one_out_r2(df: DataFrame, keys: list[str], fold: str, x: str, y: str) -> DataFrame:
    """Held-out R2 of a line fitted on all folds but one. Training sums are totals less the fold's, so facts are read once."""
    d = complete(df, x, y)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    per = d.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"), F.sum(b * b).alias("yy"))
    total = per.groupBy(*keys).agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "x", "y", "xx", "xy")))
    j = per.join(F.broadcast(total), keys) if not keys else per.join(total, keys)
    n, sx, sy, sxx, sxy = (F.col(f"t_{c}") - F.col(c) for c in ("n", "x", "y", "xx", "xy"))
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    cut = F.try_divide(sy - slope * sx, n)
    ssr = F.col("yy") - 2 * cut * F.col("y") - 2 * slope * F.col("xy") + F.col("n") * cut * cut + 2 * cut * slope * F.col("x") + slope * slope * F.col("xx")
    sst = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return j.select(*keys, ssr.alias("ssr"), sst.alias("sst")).groupBy(*keys).agg(F.when(F.sum("sst") <= TINY, 0.0).otherwise(F.least(1 - F.sum("ssr") / F.sum("sst"), F.lit(1.0))).alias("xval_r2"), F.count(F.lit(1)).alias("n_folds"))
