"""Global ranks, false discovery rates and exhaustive sign-flip permutation."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Row numbers over the whole table without a single-task sort.

    Rows are dealt out by ranges of ``order`` (whose last column must be unique),
    numbered within each range, and shifted by the sizes of the ranges before, a
    table of one row per partition. The ranges are checkpointed: dealt again, rows
    could fall into others.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, (own + F.col("_o")).cast("long")).drop("_p", "_o")


def fdr(df: DataFrame, p: str, id: str, correction: str = "none") -> DataFrame:
    """Benjamini-Hochberg q values over the whole table.

    p is floored at 1e-15; null, NaN and p of 0.9999 or more get a null q and don't
    count. ``correction`` scales q: none, or pi0, twice the share of p over 0.5. The
    running minimum from the largest p down is taken within ranges, then across
    them.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) < 0.9999)
    d = df.where(ok).withColumn("_p0", F.greatest(F.col(p), F.lit(1e-15)))
    n = d.agg(F.count(F.lit(1)).alias("_all"), F.sum(F.when(F.col("_p0") > 0.5, 1).otherwise(0)).alias("_high"))
    scale = F.lit(1.0) if correction == "none" else F.least(F.col("_high") / (0.5 * F.col("_all")), F.lit(1.0))
    r = global_rank(d, ["_p0", id], "_rank").crossJoin(F.broadcast(n)).withColumn("_raw", F.col("_p0") * F.col("_all") / F.col("_rank") * scale)
    # Ranges by rank: minima of whole ranges first.
    size = 1 << 16
    r = r.withColumn("_b", F.floor((F.col("_rank") - 1) / size))
    low = r.groupBy("_b").agg(F.min("_raw").alias("_m")).select("_b", F.min("_m").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    inside = F.min("_raw").over(Window.partitionBy("_b").orderBy(F.desc("_rank")))
    q = r.join(F.broadcast(low), "_b").withColumn("q", F.least(inside, F.col("_after"), F.lit(1.0)))
    return q.select(*df.columns, "q").union(df.where(~F.coalesce(ok, F.lit(False))).withColumn("q", F.lit(None).cast("double")))


def fdr_threshold(df: DataFrame, p: str, id: str, q: float = 0.05) -> DataFrame:
    """One row, threshold: the largest p that is at most rank / n * q; 0 if none is. Nulls and NaN don't count."""
    d = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    passing = F.when(F.col(p) <= F.col("_rank") / F.col("_n") * q, F.col(p))
    return global_rank(d, [p, id], "_rank").crossJoin(F.broadcast(n)).agg(F.coalesce(F.max(passing), F.lit(0.0)).alias("threshold"))


def label_swaps(spark, groups: list[int]) -> DataFrame:
    """(perm, unit, b) of all distinct ways to deal the labels out again; perm 0 is as given. Driver-sized: units are few."""
    n, size = len(groups), sum(groups)
    if math.comb(n, size) > 20_000:
        raise ValueError("too many label permutations to list")
    own = tuple(k for k, g in enumerate(groups) if g)
    ways = [own, *(c for c in itertools.combinations(range(n), size) if c != own)]
    return spark.createDataFrame([(p, u, int(u in w)) for p, w in enumerate(ways) for u in range(n)], "perm int, unit int, b int")


def two_sample_swap_t(df: DataFrame, swaps: DataFrame, entity: str, unit: str, y: str) -> DataFrame:
    """Pooled two-sample t (label 0 less label 1) of every entity under every dealing of labels; sums only."""
    d = df.join(F.broadcast(swaps.withColumnRenamed("unit", unit)), unit)
    one = F.when(F.col("b") == 1, F.col(y))
    two = F.when(F.col("b") == 0, F.col(y))
    s = d.groupBy("perm", entity).agg(F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0"))
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = ((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2)
    return s.select("perm", entity, ((F.col("m0") - F.col("m1")) / F.sqrt(F.greatest(pooled, F.lit(1e-30)) * (1 / n1 + 1 / n0))).alias("t"))


def empirical_cutoffs(ts: DataFrame, levels: list[float], sided: int = 2) -> DataFrame:
    """(level, cutoff): quantiles 1 - level, by linear interpolation, of the t values (sizes if two-sided) of all permutations but the first.

    Ranks are global, so no task sorts all values.
    """
    sizes = ts.where("perm > 0").select((F.abs("t") if sided == 2 else F.col("t")).alias("v"))
    return linear_quantiles(sizes, "v", [(float(x), 1 - x) for x in levels]).select(F.col("name").alias("level"), F.col("value").alias("cutoff"))


def linear_quantiles(df: DataFrame, column: str, wanted: list[tuple[float, float]]) -> DataFrame:
    """(name, value) for each (name, q) wanted: the quantile q of all values that aren't null, by linear interpolation, from global ranks."""
    d = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"), F.monotonically_increasing_id().alias("_i"))
    ranked = global_rank(d, ["_v", "_i"], "_rank").select("_rank", "_v")
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    want = df.sparkSession.createDataFrame(wanted, "name double, _q double").crossJoin(n).withColumn("_at", F.col("_q") * (F.col("_n") - 1))
    low = want.withColumn("_rank", F.floor("_at") + 1).withColumn("_w", 1 - (F.col("_at") - F.floor("_at")))
    high = want.withColumn("_rank", F.least(F.floor("_at") + 2, F.col("_n"))).withColumn("_w", F.col("_at") - F.floor("_at"))
    return ranked.join(F.broadcast(low.union(high)), "_rank").groupBy("name").agg(F.sum(F.col("_w") * F.col("_v")).alias("value"))


def sign_flips(spark, n: int) -> DataFrame:
    """(perm, unit, sign) of all 2**n flips of n units; perm 0 changes nothing."""
    if n > 14:
        raise ValueError("too many units to flip exhaustively")
    perms = spark.range(1 << n).withColumnRenamed("id", "perm")
    bit = F.shiftright(F.col("perm"), 0)
    return perms.select("perm", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.floor(bit / F.pow(F.lit(2.0), k)) % 2 == 0, 1).otherwise(-1))).alias("unit", "sign"))


def sign_flip_t(df: DataFrame, flips: DataFrame, entity: str, unit: str, y: str) -> DataFrame:
    """One-sample t of every entity under every flip; the table of flips is small and broadcast."""
    s = df.join(F.broadcast(flips), unit).groupBy("perm", entity).agg(F.sum(F.col("sign") * F.col(y)).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"), F.count(F.lit(1)).alias("n"))
    m = F.col("s") / F.col("n")
    var = F.greatest((F.col("ss") - F.col("n") * m * m) / (F.col("n") - 1), F.lit(1e-30))
    return s.select("perm", entity, (m / F.sqrt(var / F.col("n"))).alias("t"))


def permutation_p(ts: DataFrame, entity: str) -> DataFrame:
    """Per entity: t, uncorrected p (identity counts) and familywise p against the maximum of |t| over entities (identity left out)."""
    top = ts.where("perm > 0").groupBy("perm").agg(F.max(F.abs("t")).alias("top"))
    seen = ts.where("perm = 0").select(entity, F.col("t").alias("t0"))
    p = ts.join(F.broadcast(seen), entity).groupBy(entity, "t0").agg(F.avg(F.when(F.abs("t") >= F.abs(F.col("t0")) - 1e-9, 1.0).otherwise(0.0)).alias("p_unc"))
    f = seen.crossJoin(F.broadcast(top)).groupBy(entity).agg(((1 + F.sum(F.when(F.col("top") >= F.abs(F.col("t0")) - 1e-9, 1).otherwise(0))) / (F.count(F.lit(1)) + 1)).alias("p_fwe"))
    return p.join(f, entity).select(entity, F.col("t0").alias("t"), "p_unc", "p_fwe")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
