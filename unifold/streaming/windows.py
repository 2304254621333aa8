"""Structured Streaming twins of batch operators, with watermarks that bound their state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, time: str, keys: list[str], y: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """n, sum, mean and temporal signal-to-noise ratio of each tumbling or sliding window and key."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    m, s = F.avg(y), F.stddev_samp(y)
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(w.alias("w"), *keys).agg(F.count(y).alias("n"), F.sum(y).alias("total"), m.alias("mean"), F.when(s > 0, m / s).otherwise(0.0).alias("tsnr")).select(F.col("w.start").alias("start"), *keys, "n", "total", "mean", "tsnr")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of each key with no gap of that length."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def occupancy_counts(events: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Running counts of each state; shares follow by dividing, as in the batch operator."""
    return events.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n"))


def visit_counts(events: DataFrame, key: str, time: str, tie: str, state: str) -> DataFrame:
    """Visits and frames of each key and state so far, with the last state kept between batches. Rows must come in order of time."""

    def step(k, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last, names, seen, frames = held.get if held.exists else ("", [], [], [])
        count = {n: [v, f] for n, v, f in zip(names, seen, frames, strict=True)}
        for x in pd.concat(list(batches)).sort_values([time, tie])[state].tolist():
            own = count.setdefault(x, [0, 0])
            own[0] += x != last
            own[1] += 1
            last = x
        held.update((last, list(count), [c[0] for c in count.values()], [c[1] for c in count.values()]))
        yield pd.DataFrame([(k[0], n, c[0], c[1]) for n, c in count.items()], columns=[key, state, "visits", "frames"])

    kinds = dict(events.dtypes)
    return events.select(key, time, tie, state).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {state} string, visits long, frames long", "last string, names array<string>, seen array<long>, frames array<long>", "update", "NoTimeout")
