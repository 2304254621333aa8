"""Group tests, reliability, noise ceilings and other aggregates. One partial aggregation each, unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking
from .shared import settled


def _t(mean: Column, se: Column) -> Column:
    """0 where the standard error is 0."""
    return F.when(se > 0, mean / se).otherwise(0.0)


def one_sample_t(df: DataFrame, keys: list[str], y: str, mu: float = 0.0) -> DataFrame:
    n, m, s = F.count(y), F.avg(y), F.stddev_samp(y)
    return df.groupBy(*keys).agg(n.alias("n"), m.alias("mean"), _t(m - mu, s / F.sqrt(n)).alias("t"), (n - 1).alias("dof")).where("n >= 2")


def paired_t(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return one_sample_t(df.withColumn("_d", F.col(a) - F.col(b)), keys, "_d")


def two_sample_t(df: DataFrame, keys: list[str], label: str, a, b, y: str, welch: bool = False) -> DataFrame:
    """t and dof of group a against group b (values of ``label``), pooled or Welch, per key."""
    side = lambda v: F.when(F.col(label) == F.lit(v), F.col(y))
    g = df.where(F.col(label).isin(a, b)).groupBy(*keys).agg(*(x.alias(k) for v, s in ((a, "a"), (b, "b")) for x, k in ((F.count(side(v)), f"n{s}"), (F.avg(side(v)), f"m{s}"), (F.var_samp(side(v)), f"v{s}")))).where("na >= 2 and nb >= 2")
    na, nb, va, vb = (F.col(c).cast("double") for c in ("na", "nb", "va", "vb"))
    diff = F.col("ma") - F.col("mb")
    if welch:
        sa, sb = va / na, vb / nb
        den = sa * sa / (na - 1) + sb * sb / (nb - 1)
        se, dof = F.sqrt(sa + sb), F.when(den > 0, (sa + sb) * (sa + sb) / den).otherwise(1.0)
    else:
        se, dof = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), na + nb - 2
    return g.select(*keys, "na", "nb", diff.alias("diff"), _t(diff, se).alias("t"), dof.alias("dof"))


def random_effects(df: DataFrame, keys: list[str], effect: str, variance: str) -> DataFrame:
    """Meta-analysis with the method-of-moments between-group variance: mean, t, tau2 and I2. Non-positive variances are left out."""
    w = 1 / F.col("_v")
    d = df.select(*keys, F.col(effect).cast("double").alias("_b"), F.col(variance).cast("double").alias("_v")).where("_v > 0 and _b is not null")
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * F.col("_b")).alias("swb"), F.sum(w * F.col("_b") * F.col("_b")).alias("swbb")).where("n >= 2")
    q = F.greatest(F.col("swbb") - F.col("swb") * F.col("swb") / F.col("sw"), F.lit(0.0))
    tau2 = F.greatest((q - (F.col("n") - 1)) / (F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0))
    s = s.select(*keys, "n", tau2.alias("tau2"), F.when(q > 0, F.greatest((q - (F.col("n") - 1)) / q, F.lit(0.0))).otherwise(0.0).alias("i2"))
    on = d.join(s, keys) if keys else d.crossJoin(F.broadcast(s))
    v = 1 / (F.col("_v") + F.col("tau2"))
    return on.groupBy(*keys, "n", "tau2", "i2").agg((F.sum(v * F.col("_b")) / F.sum(v)).alias("mean"), (F.sum(v * F.col("_b")) / F.sqrt(F.sum(v))).alias("z"))


def robust_z(df: DataFrame, keys: list[str], y: str, least: int = 5) -> DataFrame:
    """Rows with robust_z = (y - median) / (1.4826 MAD) in their group; null for small groups or no spread. Two aggregations, joined back."""
    mid = df.groupBy(*keys).agg(F.median(y).alias("_m"), F.count(y).alias("_n"))
    with_mid = df.join(mid, keys)
    mad = with_mid.groupBy(*keys).agg(F.median(F.abs(F.col(y) - F.col("_m"))).alias("_mad"))
    z = (F.col(y) - F.col("_m")) / (1.4826 * F.col("_mad"))
    return with_mid.join(mad, keys).withColumn("robust_z", F.when((F.col("_n") >= least) & (F.col("_mad") > 0), z)).drop("_m", "_n", "_mad")


def outlier_fraction(df: DataFrame, keys: list[str], y: str, alpha: float) -> DataFrame:
    """Share of values further than alpha MADs from their group's median; none where the MAD is 0."""
    mid = df.groupBy(*keys).agg(F.median(y).alias("_m"))
    j = df.join(mid, keys).withColumn("_d", F.abs(F.col(y) - F.col("_m")))
    mad = j.groupBy(*keys).agg(F.median("_d").alias("_mad"))
    return j.join(mad, keys).groupBy(*keys).agg(F.avg(F.when((F.col("_mad") > 0) & (F.col("_d") > alpha * F.col("_mad")), 1.0).otherwise(0.0)).alias("fraction"), F.count(F.lit(1)).alias("n"))


def tsnr(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    m, s = F.avg(y), F.stddev_samp(y)
    return df.groupBy(*keys).agg(m.alias("mean"), s.alias("std"), F.when(s > 0, m / s).otherwise(0.0).alias("tsnr"))


def roi_mean(values: DataFrame, atlas: DataFrame, on: list[str], roi: list[str], y: str, w: str | None = None) -> DataFrame:
    """(Weighted) mean per region; the atlas is joined by entity, and by Spark's choice broadcast."""
    j = values.join(atlas, on)
    mean = F.avg(y) if w is None else F.try_divide(F.sum(F.col(w) * F.col(y)), F.sum(w))
    return j.groupBy(*roi).agg(mean.alias("roi_mean"), F.count(F.lit(1)).alias("n"))


def roi_paint(entities: DataFrame, roi: str, regions: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """Region values on their entities, ``fill`` where there is none."""
    return entities.join(regions, roi, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def noise_ceiling(df: DataFrame, keys: list[str], condition: str, y: str, m: float = 1.0) -> DataFrame:
    """Pooled variance within repeated conditions against the total: ncsnr and ceiling; null where there is no noise."""
    cells = df.groupBy(*keys, condition).agg(F.count(y).alias("n"), F.var_samp(y).alias("v"))
    noise = cells.where("n >= 2").groupBy(*keys).agg((F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("noise"))
    total = df.groupBy(*keys).agg(F.var_samp(y).alias("total"))
    signal = F.greatest(F.col("total") - F.col("noise"), F.lit(0.0))
    return total.join(noise, keys).select(*keys, "noise", signal.alias("signal"), F.when(F.col("noise") > 0, F.sqrt(signal / F.col("noise"))).alias("ncsnr"), F.when(F.col("noise") > 0, signal / (signal + F.col("noise") / m)).alias("ceiling"))


def split_half(df: DataFrame, keys: list[str], item: str, half: str, y: str) -> DataFrame:
    """Correlation over items of the means of half 0 and half 1, and its Spearman-Brown extension to full length."""
    side = lambda v: F.avg(F.when(F.col(half) == v, F.col(y)))
    pairs = df.groupBy(*keys, item).agg(side(0).alias("a"), side(1).alias("b")).where("a is not null and b is not null")
    r = F.corr("a", "b")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), r.alias("r"), (2 * r / (1 + r)).alias("spearman_brown"))


def dice(df: DataFrame, a: str, b: str) -> DataFrame:
    """Dice overlap of each label but 0 that is in either column."""
    long = df.select(F.explode(F.array(F.struct(F.col(a).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col(b).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s"), (F.col(a) == F.col(b)).alias("same")).select("s.*", "same")
    return long.where("label <> 0").groupBy("label").agg((F.sum(F.when(F.col("same"), 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias("dice"))


def weighted_percentile(df: DataFrame, keys: list[str], x: str, w: str, q: float) -> DataFrame:
    """The first x whose cumulative weight reaches q percent of the group's. Weights are summed by value first, so that windows see distinct values."""
    from pyspark.sql import Window

    sums = df.groupBy(*keys, x).agg(F.sum(w).alias("_w"))
    over = Window.partitionBy(*keys)
    c = sums.withColumn("_c", F.sum("_w").over(over.orderBy(x))).withColumn("_t", F.sum("_w").over(over))
    return c.where(F.col("_c") >= q / 100 * F.col("_t")).groupBy(*keys).agg(F.min(x).alias("percentile"))


def anova_two_way(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Sums of squares by means of cells, margins and all, from one cube; error within cells."""
    c = df.cube(a, b).agg(F.count(y).alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count(y)).alias("ss"), F.grouping_id().alias("g"))
    return c.select(F.col("g").cast("long").alias("level"), a, b, "n", "m", "ss")


def joint_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies and mutual information in nats of two discrete columns: one aggregation to cells, then of cells."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    h = lambda d: d.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s")).select((F.ln("n") - F.col("s") / F.col("n")).alias("h"))
    ha, hb, hab = h(cells.groupBy(a).agg(F.sum("c").alias("c"))), h(cells.groupBy(b).agg(F.sum("c").alias("c"))), h(cells)
    return ha.select(F.col("h").alias("h_a")).crossJoin(hb.select(F.col("h").alias("h_b"))).crossJoin(hab.select(F.col("h").alias("h_ab"))).withColumn("mi", F.col("h_a") + F.col("h_b") - F.col("h_ab"))


def noise_pool(df: DataFrame, score: str, id: str, threshold: float = 0.1, least: int = 100, share: float = 0.95) -> DataFrame:
    """Each row with noise_pool and criteria: score under ``threshold``, and the rest.

    A pool of more than ``share`` of the rows is cut at the order statistic there
    (the criteria stay). An error if the pool has under ``least`` rows, or if there are no criteria.
    """
    d = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    n, low = d.agg(F.count(F.lit(1)), F.count_if(F.col(score) < threshold)).first()
    if low < least or low == n:
        raise ValueError(f"{low} of {n} rows under {threshold}")
    cut, most = F.lit(threshold), int(n * share)
    if low > most:
        at = ranking.global_rank(d.select(score, id), [score, id], "_rank").where(F.col("_rank") == most + 1)
        cut = F.lit(at.first()[score])
    return d.withColumn("noise_pool", F.col(score) < cut).withColumn("criteria", F.col(score) >= threshold)


def run_mask(df: DataFrame, keys: list[str], present: Column, mean: Column, clip: float) -> DataFrame:
    """Entities that are present in every one of their runs and whose mean over runs is at least ``clip``."""
    g = df.groupBy(*keys).agg(F.bool_and(F.coalesce(present, F.lit(False))).alias("_all"), F.avg(mean).alias("mean"))
    return g.where(F.col("_all") & (F.col("mean") >= clip)).drop("_all")


def standard_scores(df: DataFrame, keys: list[str], y: str, name: str = "z") -> DataFrame:
    """y within each group, less its mean, over its standard deviation (1e-10 at least). One aggregation, joined back."""
    g = df.groupBy(*keys).agg(F.avg(y).alias("_m"), F.greatest(F.stddev_samp(y), F.lit(1e-10)).alias("_s"))
    return df.join(g, keys).withColumn(name, (F.col(y) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def symmetric_kl(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(a, b, kl) of every pair of groups, a < b: symmetric divergence of Gaussians with the groups' means and covariances of x and y.

    Facts are only summed; pairs are formed of one row per group, so groups must be few (states, labels).
    """
    g = df.groupBy(key).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.var_samp(y).alias("yy"))
    names = ("mx", "my", "xx", "xy", "yy")
    left = g.select(F.col(key).alias("a"), *(F.col(c).alias(f"{c}a") for c in names))
    right = g.select(F.col(key).alias("b"), *(F.col(c).alias(f"{c}b") for c in names))

    def one(p: str, q: str) -> Column:
        c = {k: (F.col(f"{k}{p}"), F.col(f"{k}{q}")) for k in names}
        det = c["xx"][1] * c["yy"][1] - c["xy"][1] * c["xy"][1]
        dx, dy = c["mx"][0] - c["mx"][1], c["my"][0] - c["my"][1]
        trace = c["yy"][1] * c["xx"][0] - 2 * c["xy"][1] * c["xy"][0] + c["xx"][1] * c["yy"][0]
        return ((trace + c["yy"][1] * dx * dx - 2 * c["xy"][1] * dx * dy + c["xx"][1] * dy * dy) / det - 2) / 2

    return left.join(right, F.col("a") < F.col("b")).select("a", "b", (one("a", "b") + one("b", "a")).alias("kl"))


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other beats on both columns (less is better). Only the least y for each x can, so the sweep runs over distinct x."""
    from pyspark.sql import Window

    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = ok.groupBy(x).agg(F.min(y).alias("_y"))
    # Buckets keep the running minimum off a single task: minima of whole buckets first, then within each.
    spread = settled(best.repartitionByRange(F.col(x)).withColumn("_p", F.spark_partition_id()))
    before = spread.groupBy("_p").agg(F.min("_y").alias("_m")).withColumn("_before", F.min("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    run = spread.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("_lower", F.least("_before", F.min("_y").over(Window.partitionBy("_p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))))
    front = run.where(F.col("_lower").isNull() | (F.col("_y") < F.col("_lower"))).select(x, F.col("_y").alias(y))
    return ok.join(front, [x, y])


def volume_means(df: DataFrame, entity: str, volume: str, y: str, q: float = 0.6) -> DataFrame:
    """Per volume: mean and n of the rows of entities whose mean over all volumes is at least the quantile ``q`` of all entities' means."""
    ref = settled(df.groupBy(entity).agg(F.avg(y).alias("_ref")))
    least = ranking.linear_quantiles(ref, "_ref", [(q, q)]).select("value")
    mask = ref.join(F.broadcast(least), F.col("_ref") >= F.col("value")).select(entity)
    return df.join(mask, entity, "left_semi").groupBy(volume).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
