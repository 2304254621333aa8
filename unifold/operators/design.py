"""Design building: drift, bases, convolution, trimming, folds. Designs are small tables; facts are only joined to them and summed."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linear import complete, moments, safe


def legendre(x: Column, order: int) -> list[Column]:
    """Legendre polynomials 0 to ``order`` of x in [-1, 1], each as a sum of powers."""
    out = []
    for p in range(order + 1):
        terms = [((-1) ** k * math.comb(p, k) * math.comb(2 * p - 2 * k, p) / 2**p, p - 2 * k) for k in range(p // 2 + 1)]
        out.append(sum((F.lit(c) * F.pow(x, F.lit(float(e))) for c, e in terms), F.lit(0.0)))
    return out


def drift(spark: SparkSession, n: int, order: int) -> DataFrame:
    """(t, p0, p1, ...): one row for each of n time points; not normalised. A negative order gives t alone."""
    x = F.lit(-1.0) + 2 * F.col("t") / max(n - 1, 1)
    return spark.range(n).select(F.col("id").alias("t")).select("t", *(c.alias(f"p{k}") for k, c in enumerate(legendre(x, order))))


def round_time(x: Column, mode: int | str | None, tr: float) -> Column:
    """An onset or duration to ``mode`` decimals, to the nearest multiple of tr (mode "TR"), or as it is (None); halves go to even."""
    if mode is None:
        return x
    return F.rint(x / tr) * tr if mode == "TR" else F.bround(x, int(mode))


def shift_onsets(events: DataFrame, onset: str, duration: str, shift: float, length: float) -> DataFrame:
    """Onsets less the time trimmed at the start; events that don't overlap [0, length) are dropped. An event of no duration is a point."""
    moved = F.col(onset) - shift
    return events.withColumn(onset, moved).where(~((F.col(onset) + F.coalesce(F.col(duration), F.lit(0.0)) <= 0) | (F.col(onset) >= length)))


def trim(df: DataFrame, keys: list[str], time: str, first: int, last: int) -> DataFrame:
    """Each run without its ``first`` first and ``last`` last time points; points are numbered anew in ``place``."""
    w = Window.partitionBy(*keys).orderBy(time)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = df.withColumn("place", F.row_number().over(w) - 1).withColumn("_n", n)
    return d.where((F.col("place") >= first) & (F.col("place") < F.col("_n") - last)).withColumn("place", F.col("place") - first).drop("_n")


def spikes(df: DataFrame, time: str, keep: str) -> DataFrame:
    """(time, spike): a one-hot column for each censored time point, in long form; spikes are numbered by time."""
    return df.where(F.col(keep) == 0).select(time).distinct().withColumn("spike", F.row_number().over(Window.orderBy(time)) - 1)


def tent(events: DataFrame, keys: list[str], onset: str, bottom: float, top: float, knots: int, tr: float) -> DataFrame:
    """(keys, frame, knot, x): piecewise linear basis over [bottom, top] after each onset, summed over events; zeros are left out.

    Every event is spread over the frames that it reaches, so nothing is joined by range.
    """
    width = (top - bottom) / (knots - 1)
    frames = F.sequence(F.ceil((F.col(onset) + bottom) / tr), F.floor((F.col(onset) + top) / tr))
    at = events.where(F.col(onset).isNotNull()).select(*keys, onset, F.explode(frames).alias("frame")).withColumn("_s", F.col("frame") * tr - F.col(onset))
    cells = at.withColumn("knot", F.explode(F.sequence(F.lit(0), F.lit(knots - 1)))).withColumn("_x", 1 - F.abs(F.col("_s") - (bottom + F.col("knot") * width)) / width)
    return cells.where("_x > 1e-12").groupBy(*keys, "frame", "knot").agg(F.sum("_x").alias("x"))


def convolved(df: DataFrame, keys: list[str], time: str, x: str, kernel: list[float], n: int) -> DataFrame:
    """(keys, time, y): y[t] = sum over lags of kernel[lag] * x[t - lag], for 0 <= t < n; times without input are left out."""
    lags = F.posexplode(F.array(*(F.lit(float(k)) for k in kernel))).alias("_lag", "_w")
    spread = df.select(*keys, time, x, lags).withColumn(time, F.col(time) + F.col("_lag"))
    return spread.where((F.col(time) >= 0) & (F.col(time) < n)).groupBy(*keys, time).agg(F.sum(F.col("_w") * F.col(x)).alias("y"))


def folds(spark: SparkSession, runs: list[int], left_out: int = 1, most: int = 1000, seed: int = 0) -> DataFrame:
    """(fold, run, test): all ways to leave ``left_out`` runs out, or ``most`` different ones drawn by seed if there are more."""
    if not 0 < left_out < len(runs):
        raise ValueError("some runs must train and some must test")
    if math.comb(len(runs), left_out) <= most:
        ways = list(itertools.combinations(runs, left_out))
    else:
        draw, seen = random.Random(seed), set()
        while len(seen) < most:
            seen.add(tuple(sorted(draw.sample(runs, left_out))))
        ways = sorted(seen)
    return spark.createDataFrame([(f, r, r in w) for f, w in enumerate(ways) for r in runs], "fold int, run long, test boolean")


def train_repeats(trials: DataFrame, condition: str, run: str, splits: DataFrame) -> DataFrame:
    """One row, repeats: the mean count of training trials over folds and their tested conditions, without those never trained; 1 if none is."""
    counts = trials.groupBy(condition, run).agg(F.count(F.lit(1)).alias("_c"))
    both = counts.join(F.broadcast(splits.withColumnRenamed("run", run)), run)
    per = both.groupBy("fold", condition).agg(F.bool_or("test").alias("_t"), F.sum(F.when(~F.col("test"), F.col("_c")).otherwise(0)).alias("_n"))
    return per.where("_t and _n > 0").agg(F.coalesce(F.avg("_n"), F.lit(1.0)).alias("repeats"))


def residuals(df: DataFrame, keys: list[str], x: str, y: str, name: str = "residual") -> DataFrame:
    """Rows with y less its least-squares line on x within each group; where x doesn't vary, less its mean. Incomplete rows are left out."""
    m = moments(df, keys, [x], y)
    slope = F.coalesce(safe(F.col(f"s_{x}_{y}"), F.col(f"s_{x}_{x}")), F.lit(0.0))
    line = m.select(*keys, slope.alias("_b"), F.col(f"m_{x}").alias("_mx"), F.col(f"m_{y}").alias("_my"))
    return complete(df, x, y).join(line, keys).withColumn(name, F.col(y) - F.col("_my") - F.col("_b") * (F.col(x) - F.col("_mx"))).drop("_b", "_mx", "_my")


def residual_summary(df: DataFrame, keys: list[str], time: str, residual: str) -> DataFrame:
    """Per group: n, standard deviation, lag-1 autocorrelation and largest size of residuals."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = df.withColumn("_l", F.lag(residual).over(w))
    e, lag = F.col(residual), F.col("_l")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(e).alias("sd"), (F.sum(e * lag) / F.sum(e * e)).alias("ar1"), F.max(F.abs(e)).alias("largest"))


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """r of x and y per group with z's line taken out of both; null where x or y follows z."""
    r = complete(df, x, y, z).groupBy(*keys).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"), F.count(F.lit(1)).alias("n"))
    rest = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    return r.select(*keys, "n", F.when(rest > 1e-12, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(rest)).alias("r"))


def ridge_slope(df: DataFrame, keys: list[str], x: str, y: str, penalty: float) -> DataFrame:
    """Slope of y on x per group, shrunk by a penalty on its square; x and y centred."""
    m = moments(df, keys, [x], y)
    return m.select(*keys, safe(F.col(f"s_{x}_{y}"), F.col(f"s_{x}_{x}") + penalty).alias("slope"))


def percent_change(beta: Column, mean: Column) -> Column:
    """100 * beta / |mean|; null where the mean is 0."""
    return 100 * F.try_divide(beta, F.abs(mean))


def single_trials(events: DataFrame, trial: str, onset: str, duration: str, tr: float) -> DataFrame:
    """(trial, frame, x): one regressor a trial, the share of each frame of length tr that it covers; trials of no duration are left out."""
    start, end = F.col(onset), F.col(onset) + F.col(duration)
    frames = F.sequence(F.floor(start / tr), F.ceil(end / tr) - 1)
    cells = events.where(F.col(duration) > 0).select(trial, start.alias("_a"), end.alias("_b"), F.explode(frames).alias("frame"))
    share = (F.least("_b", (F.col("frame") + 1) * tr) - F.greatest("_a", F.col("frame") * tr)) / tr
    return cells.select(trial, "frame", share.alias("x")).where("x > 1e-12")


def order_trials(trials: DataFrame, keys: list[str], onset: str, condition: str, id: str) -> DataFrame:
    """Trials numbered from 0 by time, and by condition and then time, within each group; ``id`` breaks ties."""
    w = Window.partitionBy(*keys)
    by_time, by_condition = w.orderBy(onset, id), w.orderBy(condition, onset, id)
    return trials.withColumn("by_time", F.row_number().over(by_time) - 1).withColumn("by_condition", F.row_number().over(by_condition) - 1)


def two_sample_columns(df: DataFrame, is_a: Column, covariates: list[str]) -> DataFrame:
    """``df`` with an intercept and the covariates for each of two sets: a_0, a_1, ..., b_0, b_1, ...; 0 in the other set's rows."""
    values = [F.lit(1.0), *(F.col(c).cast("double") for c in covariates)]
    sides = (("a", is_a), ("b", ~is_a))
    return df.select("*", *(F.when(own, v).otherwise(0.0).alias(f"{s}_{k}") for s, own in sides for k, v in enumerate(values)))


def leave_one_out_slopes(df: DataFrame, keys: list[str], fold: str, x: Column, y: Column) -> DataFrame:
    """(keys, fold, slope) of y on x fitted without each fold: totals less the fold's sums, so facts are read once."""
    names = ("n", "x", "y", "xx", "xy")
    d = df.select(*keys, fold, x.alias("_x"), y.alias("_y")).where("_x is not null and _y is not null")
    a, b = F.col("_x"), F.col("_y")
    per = d.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"))
    total = per.groupBy(*keys).agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    n, sx, sy, sxx, sxy = (F.col(f"t_{c}") - F.col(c) for c in names)
    det = n * sxx - sx * sx
    return per.join(total, keys).select(*keys, fold, F.when(det > 1e-9, (n * sxy - sx * sy) / det).alias("slope"))


def coverage(df: DataFrame, keys: list[str], time: str, n: int, least: float) -> DataFrame:
    """Entities seen at ``least`` of n times or more, with that share."""
    return df.groupBy(*keys).agg((F.countDistinct(time) / F.lit(n)).alias("share")).where(F.col("share") >= least)
