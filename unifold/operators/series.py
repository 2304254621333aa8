"""Window and sequence operators. All windows are partitioned by entity and ordered by time and a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def backward_diff(df: DataFrame, keys: list[str], order: list[str], y: str) -> DataFrame:
    """y less its predecessor; 0 at the start of each run."""
    return df.withColumn("diff", F.coalesce(F.col(y) - F.lag(y).over(over(keys, order)), F.lit(0.0)))


def enorm(df: DataFrame, keys: list[str], order: list[str], ys: list[str]) -> DataFrame:
    """Euclidean norm of the backward differences of several columns."""
    w = over(keys, order)
    total = sum((F.pow(F.coalesce(F.col(y) - F.lag(y).over(w), F.lit(0.0)), 2) for y in ys), F.lit(0.0))
    return df.withColumn("enorm", F.sqrt(total))


def framewise_displacement(df: DataFrame, keys: list[str], order: list[str], shifts: list[str], turns_deg: list[str], radius: float = 50.0) -> DataFrame:
    """Sum of absolute backward differences; turns count as arcs on a sphere."""
    w = over(keys, order)
    step = lambda c: F.abs(F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    return df.withColumn("fd", sum([step(c) for c in shifts] + [radius * F.radians(step(c)) for c in turns_deg], F.lit(0.0)))


def censor(df: DataFrame, keys: list[str], order: list[str], y: str, limit: float, prev: bool = True, nxt: bool = False, first: int = 0) -> DataFrame:
    """keep: 1 where |y| is at most ``limit``, nor is a neighbour's over it, nor is it one of the first rows. Null and NaN censor."""
    w = over(keys, order)
    bad = F.when(F.col(y).isNull() | F.isnan(y) | (F.abs(y) > limit), 1).otherwise(0)
    d = df.withColumn("_b", bad)
    out = F.col("_b")
    if prev:
        out = F.greatest(out, F.coalesce(F.lead("_b").over(w), F.lit(0)))
    if nxt:
        out = F.greatest(out, F.coalesce(F.lag("_b").over(w), F.lit(0)))
    if first:
        out = F.when(F.row_number().over(w) <= first, 1).otherwise(out)
    return d.withColumn("keep", 1 - out).drop("_b")


def moving_average(df: DataFrame, keys: list[str], order: list[str], y: str, half: int) -> DataFrame:
    """Centred mean of 2 half + 1 values; the first and last value stand for those beyond the ends."""
    w = over(keys, order)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    box = w.rowsBetween(-half, half)
    k, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    before, after = F.greatest(half - k + 1, F.lit(0)), F.greatest(k + half - n, F.lit(0))
    total = F.sum(y).over(box) + before * F.first(y).over(whole) + after * F.last(y).over(whole)
    return df.withColumn("smooth", total / (2 * half + 1))


def percent_scale(df: DataFrame, keys: list[str], y: str, top: float = 200.0) -> DataFrame:
    """y in percent of its group's mean, at most ``top``."""
    return df.withColumn("scaled", F.least(F.try_divide(F.col(y) * 100.0, F.avg(y).over(Window.partitionBy(*keys))), F.lit(top)))


def lags(df: DataFrame, keys: list[str], order: list[str], y: str, n: int) -> DataFrame:
    """Columns lag_0 to lag_(n-1): finite impulse response regressors; 0 before the start."""
    w = over(keys, order)
    return df.select("*", *(F.coalesce(F.lag(y, k).over(w), F.lit(0)).alias(f"lag_{k}") for k in range(n)))


# -- states --------------------------------------------------------------------------


def visits(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Maximal runs of one state: (keys, state, visit number, frames). One window pass, then an aggregation."""
    w = over(keys, order)
    change = F.when(F.lag(state).over(w) == F.col(state), 0).otherwise(1)
    runs = df.select(*keys, *order, state, change.alias("_c")).withColumn("visit", F.sum("_c").over(w))
    return runs.groupBy(*keys, "visit", state).agg(F.count(F.lit(1)).alias("frames"))


def occupancy(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Share of each state among a group's frames."""
    c = df.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("occupancy", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def effective_states(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """exp of the entropy of the occupancy."""
    o = occupancy(df, keys, state)
    return o.groupBy(*keys).agg(F.exp(-F.sum(F.col("occupancy") * F.ln("occupancy"))).alias("effective"))


def mean_lifetime(df: DataFrame, keys: list[str], order: list[str], state: str, tr: float = 1.0) -> DataFrame:
    """Frames per visit of each state, times tr."""
    v = visits(df, keys, order, state)
    return v.groupBy(state).agg(F.count(F.lit(1)).alias("visits"), F.sum("frames").alias("frames"), (F.sum("frames") / F.count(F.lit(1)) * tr).alias("lifetime"))


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Share of each next state among those that follow a state, itself included."""
    nxt = df.select(F.col(state).alias("source"), F.lead(state).over(over(keys, order)).alias("target")).where("target is not null")
    c = nxt.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def switch_rate(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    s = df.select(*keys, F.lag(state).over(over(keys, order)).alias("_l"), state).where("_l is not null")
    return s.groupBy(*keys).agg(F.avg(F.when(F.col("_l") != F.col(state), 1.0).otherwise(0.0)).alias("rate"), F.count(F.lit(1)).alias("n"))


def switch_paths(df: DataFrame, keys: list[str], order: list[str], state: str, length: int = 3) -> DataFrame:
    """Counts of state paths over visits."""
    v = visits(df, keys, order, state)
    w = over(keys, ["visit"])
    steps = v.select(*(F.lead(state, k).over(w).alias(f"s{k}") if k else F.col(state).alias("s0") for k in range(length)))
    return steps.where(F.col(f"s{length - 1}").isNotNull()).groupBy(*(f"s{k}" for k in range(length))).agg(F.count(F.lit(1)).alias("n"))


def conditional_entropy(df: DataFrame, keys: list[str], order: list[str], state: str, depth: int = 1) -> DataFrame:
    """Bits of the next state given the last ``depth`` ones."""
    w = over(keys, order)
    back = [f"c{k}" for k in range(depth)]
    g = df.select(*(F.lag(state, k + 1).over(w).alias(f"c{k}") for k in range(depth)), F.col(state).alias("nxt")).where(" and ".join(f"{c} is not null" for c in back))
    c = g.groupBy(*back, "nxt").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("m", F.sum("n").over(Window.partitionBy(*back)))
    return c.agg((-F.sum(F.col("n") * F.log2(F.col("n") / F.col("m"))) / F.sum("n")).alias("bits"), F.sum("n").alias("n"))


# -- events --------------------------------------------------------------------------


def canonical(label: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(label, r"\s+", " "))


def filter_events(df: DataFrame, column: str, values: list, keep: bool = True) -> DataFrame:
    """Rows whose value equals one of ``values`` as text or as number (or none of them). Unknown columns are an error."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    text = F.coalesce(F.col(column).cast("string"), F.lit("")).isin([str(v) for v in values])
    numbers = []
    for v in values:
        try:
            numbers.append(float(v))
        except ValueError:
            pass
    number = F.coalesce(F.expr(f"try_cast(`{column}` as double)").isin(numbers), F.lit(False)) if numbers else F.lit(False)
    return df.where(text | number) if keep else df.where(~(text | number))


def parse_events(df: DataFrame, run: str, label: str, onset: str, duration: str) -> DataFrame:
    """Sorted onsets of each label and run, and the label's duration: its only one, or the median of the distinct ones."""
    ok = df.where(F.col(label).isNotNull() & ~F.lower(F.trim(F.col(label))).isin("", "n/a"))
    onsets = ok.groupBy(label, run).agg(F.sort_array(F.collect_list(onset)).alias("onsets"))
    return onsets.join(ok.select(label, duration).distinct().groupBy(label).agg(F.median(duration).alias("duration")), label)


def trial_table(df: DataFrame, run: str, onset: str, tie: str, label: str) -> DataFrame:
    """Trials in the order of their runs and onsets, numbered within runs, and each one's repetition of its label."""
    w = Window.partitionBy(run).orderBy(onset, tie)
    return df.withColumn("trial", F.row_number().over(w)).withColumn("repetition", F.row_number().over(Window.partitionBy(run, label).orderBy(onset, tie)))


def interval_labels(events: DataFrame, key: str, onset: str, duration: str, label: str, tr: float, n_frames: int, delay: float = 0.0) -> DataFrame:
    """Labels painted on the frames [start, end) of each key; of overlapping events the later onset, then the larger label, wins.

    Each event explodes to its own frames, so there is no range join.
    """
    start = F.bround((F.col(onset) + delay) / tr).cast("int")
    size = F.bround(F.col(duration) / tr).cast("int")
    e = events.select(key, onset, label, F.greatest(start, F.lit(0)).alias("s"), F.least(start + size, F.lit(n_frames)).alias("e")).where("e > s")
    frames = e.select(key, F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("frame"), onset, label)
    return frames.groupBy(key, "frame").agg(F.max(F.struct(onset, label)).alias("m")).select(key, "frame", F.col(f"m.{label}").alias("label"))


def asof_labels(frames: DataFrame, events: DataFrame, keys: list[str], time: str, label: str, tie: str) -> DataFrame:
    """The label of the last event at or before each frame, by one union and a window: both sides are sorted once per key."""
    a = events.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_k"), F.col(tie).alias("_u"), F.col(label).alias("label"))
    b = frames.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(dict(events.dtypes)[tie]).alias("_u"), F.lit(None).cast(dict(events.dtypes)[label]).alias("label"))
    w = Window.partitionBy(*keys).orderBy("_t", "_k", "_u").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("label", F.last("label", ignorenulls=True).over(w)).where("_k = 1").select(*keys, F.col("_t").alias(time), "label")
