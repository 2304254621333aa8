"""Phases, peaks, spectra, filters and grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled


def scaled_phase(df: DataFrame, phase: str, name: str = "radians") -> DataFrame:
    """The column's whole range mapped to [-pi, pi]; null where it has no range."""
    low = df.agg(F.min(phase).alias("_lo"), F.max(phase).alias("_hi"))
    return df.crossJoin(F.broadcast(low)).withColumn(name, F.try_divide(F.col(phase) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (2 * math.pi) - math.pi).drop("_lo", "_hi")


def phase_to_hz(phase: Column, te_ms: float, units: str) -> Column:
    if units not in ("hz", "rad"):
        raise ValueError(f"unknown units {units!r}")
    return phase if units == "hz" else phase / (2 * math.pi * te_ms * 1e-3)


def unwrapped(df: DataFrame, keys: list[str], time: str, phase: str, name: str = "unwrapped") -> DataFrame:
    """Phases of each series without jumps of over half a turn from one time to the next."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = df.withColumn("_j", F.coalesce(F.rint((F.col(phase) - F.lag(phase).over(w)) / (2 * math.pi)), F.lit(0.0)))
    return d.withColumn(name, F.col(phase) - 2 * math.pi * F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def peak(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per group: the place of the largest y (the first of equals) and its offset in grid steps, by a parabola.

    A parabola through five points, of three next to an end, none at an end; offsets are cut at one step.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    near = [(F.col(y) if k == 2 else F.lag(y, 2 - k).over(w) if k < 2 else F.lead(y, k - 2).over(w)).alias(f"_{k}") for k in range(5)]
    d = df.select(*keys, x, y, *near)
    top = d.groupBy(*keys).agg(F.max_by(F.struct(x, *(f"_{k}" for k in range(5))), F.struct(F.col(y), -F.col(x))).alias("p")).select(*keys, "p.*")
    a, b, c, e, g = (F.col(f"_{k}") for k in range(5))
    curve = (5 * (4 * a + b + e + 4 * g) - 10 * (a + b + c + e + g)) / 70
    five = F.when(F.abs(curve) > 1e-9, -((-2 * a - b + e + 2 * g) / 10) / (2 * curve)).otherwise(0.0)
    bend = b - 2 * c + e
    three = F.when(F.abs(bend) > 1e-6, (b - e) / bend / 2).otherwise(0.0)
    cut = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    return top.select(*keys, x, F.when(a.isNotNull() & g.isNotNull(), cut(five)).when(b.isNotNull() & e.isNotNull(), cut(three)).otherwise(0.0).alias("offset"))


def savgol_weights(window: int, order: int) -> list[float]:
    """Weights of the value at the middle of a least-squares polynomial over an odd window."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and longer than the order")
    k = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(k, order + 1, increasing=True).astype(float))[0].tolist()


def savgol(df: DataFrame, keys: list[str], time: str, y: str, window: int, order: int, name: str = "smooth") -> DataFrame:
    """Savitzky-Golay smoothing of evenly sampled series; null where the window leaves the series."""
    w, half = Window.partitionBy(*keys).orderBy(time), window // 2
    at = lambda k: F.col(y) if not k else F.lag(y, -k).over(w) if k < 0 else F.lead(y, k).over(w)
    return df.withColumn(name, sum(F.lit(c) * at(k - half) for k, c in enumerate(savgol_weights(window, order))))


def periodogram(df: DataFrame, keys: list[str], place: str, y: str, n: int, tr: float) -> DataFrame:
    """(keys, k, hz, power): one-sided power of centred series of n samples at place 0 to n - 1.

    Every sample meets n / 2 frequencies and is summed at once (partial
    aggregation), so no series is collected.
    """
    centred = df.join(df.groupBy(*keys).agg(F.avg(y).alias("_m")), keys)
    d = centred.select(*keys, (F.col(y) - F.col("_m")).alias("_y"), F.col(place).alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(n // 2))).alias("k"))
    angle = 2 * math.pi * ((F.col("k") * F.col("_t")) % n) / n
    s = d.groupBy(*keys, "k").agg(F.sum(F.col("_y") * F.cos(angle)).alias("_c"), F.sum(F.col("_y") * F.sin(angle)).alias("_s"))
    both = F.when(F.col("k") * 2 == n, 1.0).otherwise(2.0)
    return s.select(*keys, "k", (F.col("k") / (n * tr)).alias("hz"), (both * tr / n * (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))).alias("power"))


def uniform_image(first: Column, second: Column, scale: float = 1.0, regular: float = 0.0) -> Column:
    """(k a b - r) / ((k a)^2 + b^2 + 2 r), in [-0.5, 0.5]; 0 where nothing was measured."""
    a = scale * first
    den = a * a + second * second + 2 * regular
    return F.when(den > 1e-12, (a * second - regular) / den).otherwise(0.0)


def decay_rmse(df: DataFrame, keys: list[str], time: str, echo: Column, y: Column, s0: Column, t2: Column) -> DataFrame:
    """Per entity: over its times, the mean of the root mean square over echoes of y less s0 exp(-echo / t2)."""
    r = y - s0 * F.exp(-echo / t2)
    per = df.select(*keys, time, (r * r).alias("_q")).groupBy(*keys, time).agg(F.sqrt(F.avg("_q")).alias("_e"))
    return per.groupBy(*keys).agg(F.avg("_e").alias("rmse"))


def mesh_edges(faces: DataFrame, corners: list[str]) -> DataFrame:
    """(a, b), a <= b: the distinct edges of triangles."""
    pairs = F.array(*(F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in zip(corners, corners[1:] + corners[:1], strict=True)))
    return faces.select(F.explode(pairs).alias("e")).select("e.*").distinct()


def offsets(reach: float, sizes: list[float], shape: str = "sphere") -> list[tuple[int, ...]]:
    """Grid steps to the cells within ``reach`` of a cell, itself included: a sphere, or a box (rect)."""
    from itertools import product

    steps = [range(-int(reach // s + 1e-9), int(reach // s + 1e-9) + 1) for s in sizes]
    return [o for o in product(*steps) if shape == "rect" or sum((k * s) ** 2 for k, s in zip(o, sizes, strict=True)) <= reach * reach * (1 + 1e-12)]


def neighbour_mean(df: DataFrame, axes: list[str], y: str, steps: list[tuple[int, ...]]) -> DataFrame:
    """(axes, n, mean) over the cells of each cell's neighbourhood that exist: cells are sent to their neighbours, no cell joins all."""
    moves = F.array(*(F.struct(*(F.lit(int(k)).alias(a) for a, k in zip(axes, o, strict=True))) for o in steps))
    sent = df.select(*axes, y, F.explode(moves).alias("_o")).select(*((F.col(a) + F.col("_o")[a]).alias(a) for a in axes), y)
    return sent.groupBy(*axes).agg(F.count(y).alias("n"), F.avg(y).alias("mean")).join(df.select(*axes), axes, "left_semi")


def grid_fwhm(df: DataFrame, axes: dict[str, float], y: str) -> DataFrame:
    """One row: smoothness along each axis (name_fwhm) of a field on a grid, from the variance of first differences; null where undefined."""
    names = list(axes)
    base = df.select(*names, F.col(y).cast("double").alias("_y"))
    total = base.agg(F.var_pop("_y").alias("_v"))
    for name, size in axes.items():
        after = base.select(*(F.col(a) if a != name else (F.col(a) - 1).alias(a) for a in names), F.col("_y").alias("_z"))
        step = base.join(after, names).agg(F.var_pop(F.col("_z") - F.col("_y")).alias("_d"))
        arg = 1 - F.col("_d") / F.col("_v") / 2
        width = F.when((arg > 0) & (arg < 1), math.sqrt(8 * math.log(2)) * F.sqrt(-1 / (4 * F.ln(arg))) * size)
        total = total.crossJoin(F.broadcast(step)).withColumn(f"{name}_fwhm", width).drop("_d")
    return total.drop("_v")


def clusters(df: DataFrame, axes: list[str], y: str, cutoff: float, least: int = 1) -> DataFrame:
    """(axes, cluster, size) of the cells with y over ``cutoff``: face neighbours share a cluster, numbered by its least cell.

    Labels spread along neighbours and along what labels already point to, so rounds grow with the logarithm of a cluster's extent.
    Each round is checkpointed.
    """
    cell = F.struct(*axes)
    live = settled(df.where(F.col(y) > cutoff).select(*axes).distinct())
    steps = [tuple(s if a == b else 0 for b in axes) for a in axes for s in (-1, 1)]
    moved = F.explode(F.array(*(F.struct(*((F.col(a) + F.lit(k)).alias(a) for a, k in zip(axes, o, strict=True))) for o in steps)))
    edges = settled(live.select(cell.alias("a"), moved.alias("b")).join(live.select(cell.alias("b")), "b").select("a", "b"))
    labels = live.select(cell.alias("a"), cell.alias("c"))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        best = labels.join(near, "a", "left").select("a", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c"))
        jump = best.select(F.col("a").alias("c"), F.col("c").alias("d"))
        new = settled(best.join(jump, "c", "left").select("a", "old", F.least("c", "d").alias("c")))
        labels = new.select("a", "c")
        if new.where("old <> c").isEmpty():
            break
    size = labels.groupBy("c").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return labels.join(size, "c").select("a.*", F.col("c").alias("cluster"), "size")
