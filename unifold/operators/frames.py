"""Frames, masks, grids and checks: scalar and small aggregate operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def invalid_entities(df: DataFrame, entity: str, run: str, y: str) -> DataFrame:
    """Entities with a value that isn't finite, or with a run of nothing but zeros."""
    bad = F.col(y).isNull() | F.isnan(F.col(y).cast("double")) | (F.abs(y) == float("inf"))
    per = df.groupBy(entity, run).agg(F.max(F.when(bad, 1).otherwise(0)).alias("bad"), F.max(F.when(bad, 0.0).otherwise(F.abs(y))).alias("top"))
    return per.groupBy(entity).agg(F.max(F.when((F.col("bad") == 1) | (F.col("top") == 0), 1).otherwise(0)).alias("invalid")).where("invalid = 1").select(entity)


def nearest_rank(df: DataFrame, keys: list[str], y: str, q: float, tie: str) -> DataFrame:
    """The value of rank round(q (n - 1)), halves to even, from 0."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_k", F.row_number().over(w.orderBy(y, tie)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.where(F.col("_k") == F.bround(F.lit(q) * (F.col("_n") - 1)).cast("int")).select(*keys, F.col(y).alias("quantile"))


def bounds(df: DataFrame, axes: list[str], value: Column) -> DataFrame:
    """Least and largest place on each axis where ``value`` isn't 0."""
    return df.where(value != 0).agg(*(f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "low"), (F.max, "high"))))


def polar(magnitude: Column, phase: Column) -> tuple[Column, Column]:
    return magnitude * F.cos(phase), magnitude * F.sin(phase)


def cartesian(real: Column, imag: Column) -> tuple[Column, Column]:
    return F.hypot(real, imag), F.atan2(imag, real)


def alias(frequency: Column, tr: float) -> Column:
    """The frequency between 0 and half the sampling rate that one appears at."""
    fs = 1 / tr
    m = F.pmod(frequency, F.lit(fs))
    return F.least(m, fs - m)


def receptive_field(x: Column, y: Column, x0: float, y0: float, sigma: float) -> Column:
    return F.exp(-((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)


def acf(r: Column, a: float, b: float, c: float) -> Column:
    """Mixed Gaussian and exponential autocorrelation at distance r."""
    return a * F.exp(-r * r / (2 * b * b)) + (1 - a) * F.exp(-r / c)


def late_events(events: DataFrame, lengths: DataFrame, run: str, onset: str, length: str, keep: bool) -> DataFrame:
    """Events that begin within their run (keep) or at or past its end. Runs are few: their table is joined as Spark sees fit."""
    j = events.join(lengths, run)
    return (j.where(F.col(onset) < F.col(length)) if keep else j.where(F.col(onset) >= F.col(length))).select(*events.columns)


def duplicates(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_vs_all(df: DataFrame, label: str, a, drop: list) -> DataFrame:
    """side A for rows of label a, B for all others but those dropped."""
    return df.where((F.col(label) == F.lit(a)) | ~F.col(label).isin(drop)).withColumn("side", F.when(F.col(label) == F.lit(a), "A").otherwise("B"))


def onset_counts(events: DataFrame, keys: list[str], onset: str, tr: float, n_frames: int) -> DataFrame:
    """Events at each frame, onsets rounded half to even and kept within the run."""
    t = F.greatest(F.least(F.bround(F.col(onset) / tr).cast("int"), F.lit(n_frames - 1)), F.lit(0))
    return events.groupBy(*keys, t.alias("frame")).agg(F.count(F.lit(1)).alias("n"))


def expanded(events: DataFrame, onset: str, duration: str, label: str) -> DataFrame:
    """Each block as an onset event, an offset event and a sustained one."""
    one = lambda t, d, s: F.struct(t.cast("double").alias("onset"), d.cast("double").alias("duration"), F.concat(F.col(label), F.lit(s)).alias("label"))
    o, d = F.col(onset), F.col(duration)
    rest = [c for c in events.columns if c not in (onset, duration, label)]
    return events.select(*rest, F.explode(F.array(one(o, F.lit(0.0), "_on"), one(o + d, F.lit(0.0), "_off"), one(o, d, "_sustained"))).alias("e")).select(*rest, "e.*")


def combined_keep(masks: list[DataFrame], key: str) -> DataFrame:
    """keep is 1 where every mask keeps."""
    out = masks[0]
    for m in masks[1:]:
        out = out.union(m)
    return out.groupBy(key).agg(F.min("keep").alias("keep"))


def windowed_switch_rate(df: DataFrame, keys: list[str], order: list[str], state: str, window: int) -> DataFrame:
    """Share of changes among the steps in a centred window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = df.withColumn("_s", F.when(F.lag(state).over(w).isNull(), None).when(F.lag(state).over(w) != F.col(state), 1.0).otherwise(0.0)).where("_s is not null")
    return step.withColumn("rate", F.avg("_s").over(w.rowsBetween(-(window // 2), window // 2))).drop("_s")


def switching_over_time(df: DataFrame, session: str, order: list[str], state: str) -> DataFrame:
    """Probability over sessions of a change at each step."""
    w = Window.partitionBy(session).orderBy(*order)
    s = df.select(F.row_number().over(w).alias("step"), F.lag(state).over(w).alias("_l"), F.col(state).alias("_s")).where("_l is not null")
    return s.groupBy("step").agg(F.avg(F.when(F.col("_l") != F.col("_s"), 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).alias("n"))


def jackknife(df: DataFrame, block: str, x: str, y: str) -> DataFrame:
    """Slope of y on x and its delete-one-block variance; each block's sums are taken from the total."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    per = df.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"))
    total = per.agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "x", "y", "xx", "xy")))
    slope = lambda n, sx, sy, sxx, sxy: (n * sxy - sx * sy) / (n * sxx - sx * sx)
    j = per.crossJoin(F.broadcast(total))
    left = slope(*(F.col(f"t_{c}") - F.col(c) for c in ("n", "x", "y", "xx", "xy")))
    whole = slope(*(F.col(f"t_{c}") for c in ("n", "x", "y", "xx", "xy")))
    return j.select(left.alias("v"), whole.alias("slope")).groupBy("slope").agg(F.count(F.lit(1)).alias("blocks"), (F.var_pop("v") * (F.count(F.lit(1)) - 1)).alias("variance"))


def ljung_box(df: DataFrame, keys: list[str], order: list[str], y: str, regressors: int = 0) -> DataFrame:
    """Per key: n, lags, dof and the Ljung-Box statistic of the centred series.

    Lags follow the length: regressors + 2 + min(n / 8, round(3 ln n)), at most n / 2.
    Series of under 10 rows, and constant ones, get 0. Null values don't count.
    """
    d = df.where(F.col(y).isNotNull())
    whole = Window.partitionBy(*keys)
    n = F.col("n")
    lags = F.least(regressors + 2 + F.least(F.floor(n / 8), F.round(3 * F.log(n.cast("double"))).cast("long")), F.floor(n / 2))
    # One number, which grows with the logarithm of the longest series.
    most = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max(lags).alias("h")).first()["h"] or 0
    c = d.select(*keys, *order, (F.col(y) - F.avg(y).over(whole)).alias("_c"), F.count(F.lit(1)).over(whole).alias("n")).withColumn("lags", lags)
    w = whole.orderBy(*order)
    c = c.select(*keys, "n", "lags", "_c", *(F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, most + 1)))
    s = c.groupBy(*keys, "n", "lags").agg(F.sum(F.col("_c") * F.col("_c")).alias("_0"), *(F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_{k}") for k in range(1, most + 1)))
    terms = sum((F.when(F.col("lags") >= k, F.pow(F.col(f"_{k}") / F.col("_0"), 2.0) / (n - k)).otherwise(0.0) for k in range(1, most + 1)), F.lit(0.0))
    q = F.when((n >= 10) & (F.col("_0") >= 1e-10), n * (n + 2) * terms).otherwise(0.0)
    return s.select(*keys, "n", "lags", F.greatest(F.col("lags") - 2, F.lit(1)).alias("dof"), q.alias("ljung_box"))


def state_bins(df: DataFrame, columns: list[str], levels: int, least: int) -> DataFrame:
    """Per combination of columns, each scaled to [0, 1] and cut into ``levels``: its bins, n, the state it belongs to and that state's rows.

    States of fewer than ``least`` rows are merged into the nearest one by mean scaled
    values, the smallest first (ties: the first by bins). There are at most
    ``levels`` to the power of the columns, which is checked; only those reach the
    driver. Rows with a null among the columns are left out.
    """
    if levels < 2 or levels ** len(columns) > 1 << 16:
        raise ValueError("levels must be 2 or more, and their combinations at most 65536")
    spark, d = df.sparkSession, df.dropna(subset=columns).select(*(F.col(c).cast("double").alias(c) for c in columns))
    ends = d.agg(*(f(c).alias(f"_{k}{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    z = d.crossJoin(F.broadcast(ends)).select(*(((F.col(c) - F.col(f"_lo{c}")) / F.greatest(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(1e-12))).alias(c) for c in columns))
    bins = [F.least(F.floor(F.col(c) * levels), F.lit(levels - 1)).cast("int").alias(f"bin_{c}") for c in columns]
    names = [f"bin_{c}" for c in columns]
    found = sorted(z.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns))).collect(), key=lambda r: [r[x] for x in names])
    states = {k: [[k], r["n"], [r[f"_s{j}"] for j in range(len(columns))]] for k, r in enumerate(found)}
    while len(states) > 1:
        small = min(states, key=lambda k: (states[k][1], k))
        if states[small][1] >= least:
            break
        own, n, sums = states.pop(small)
        near = min(states, key=lambda k: (sum((x / states[k][1] - y / n) ** 2 for x, y in zip(states[k][2], sums, strict=True)), k))
        into = states.pop(near)
        states[min(near, small)] = [into[0] + own, into[1] + n, [x + y for x, y in zip(into[2], sums, strict=True)]]
    state = {k: (i, states[s][1]) for i, s in enumerate(sorted(states)) for k in states[s][0]}
    rows = [(*(r[x] for x in names), r["n"], *state[k]) for k, r in enumerate(found)]
    return spark.createDataFrame(rows, ", ".join([*(f"{x} int" for x in names), "n long, state int, state_n long"]))


def patterns(df: DataFrame, entity: str, run: str, y: str, runs: list) -> DataFrame:
    """How many entities share each pattern of runs with data."""
    v = df.groupBy(entity).agg(F.array_sort(F.collect_set(F.when(F.col(y).isNotNull() & F.col(run).isin(runs), F.col(run)))).alias("pattern"))
    return v.groupBy(F.array_join(F.transform("pattern", lambda x: x.cast("string")), ",").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def variance_from_t(beta: Column, t: Column) -> Column:
    return F.try_divide(beta, t) * F.try_divide(beta, t)


def factor_alignment(df: DataFrame, a: str, b: str) -> DataFrame:
    """Crosstab of two labels with shares within each ``a``."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def consistency(df: DataFrame, r: str, thresholds: list[float]) -> DataFrame:
    """Mean, median and shares over thresholds of a column of correlations."""
    return df.agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), *(F.avg(F.when(F.col(r) >= t, 1.0).otherwise(0.0)).alias(f"over_{round(100 * t)}") for t in thresholds))
