"""Correlations and similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(df: DataFrame, keys: list[str], y: str, name: str) -> DataFrame:
    """Ranks from 1, ties averaged. Ranks are of distinct values with their counts, then joined back: windows see no repeats."""
    c = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    r = c.withColumn(name, F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(r, [*keys, y])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(d, keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def circular(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Circular correlation of two angles in radians: mean directions first, then sums of sines about them."""
    mean = lambda c: F.atan2(F.avg(F.sin(c)), F.avg(F.cos(c)))
    m = df.groupBy(*keys).agg(mean(x).alias("_mx"), mean(y).alias("_my"))
    j = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    sx, sy = F.sin(F.col(x) - F.col("_mx")), F.sin(F.col(y) - F.col("_my"))
    den = F.sqrt(F.sum(sx * sx) * F.sum(sy * sy))
    return j.groupBy(*keys).agg(F.when(den > 0, F.sum(sx * sy) / den).otherwise(0.0).alias("r"))


def unpacked(df: DataFrame, entity: str, array: str) -> DataFrame:
    """(entity, t, v) of an array column."""
    return df.select(entity, F.posexplode(array).alias("t", "v")).withColumn("v", F.col("v").cast("double"))


def seed(df: DataFrame, entity: str, array: str, at) -> DataFrame:
    """Correlation of each entity's series with one entity's, which is broadcast as one row."""
    one = df.where(F.col(entity) == at).select(F.col(array).alias("_s")).limit(1)
    both = df.crossJoin(F.broadcast(one)).select(entity, F.posexplode(F.arrays_zip(F.col(array).alias("a"), F.col("_s").alias("b"))).alias("t", "p"))
    return both.groupBy(entity).agg(F.corr(F.col("p.a").cast("double"), F.col("p.b").cast("double")).alias("r"))


def pairwise(series: DataFrame, entity: str, time: str, v: str) -> DataFrame:
    """Correlation of every two of a few entities (maps, regions) over a shared time axis: an equi-join on time, then one aggregation."""
    a = series.select(F.col(entity).alias("a"), time, F.col(v).alias("_x"))
    b = series.select(F.col(entity).alias("b"), time, F.col(v).alias("_y"))
    return a.join(b, time).where("a < b").groupBy("a", "b").agg(F.corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))


def distance_histogram(pairs: DataFrame, r: str, bins: int) -> DataFrame:
    """Pairs' correlations in equal bins on [-1, 1]."""
    b = F.least(F.floor((F.col(r) + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_r"))


def local_pearson(df: DataFrame, block: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Correlation within each block and its Fisher transform; blocks of few rows or without spread are left out."""
    r = df.groupBy(*block).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")).where(f"n >= {least} and r is not null and not isnan(r)")
    c = F.greatest(F.least("r", F.lit(0.9999)), F.lit(-0.9999))
    return r.withColumn("z", F.ln((1 + c) / (1 - c)))
