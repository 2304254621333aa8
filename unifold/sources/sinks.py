"""Sinks: long result tables, one folder for each statistic, and tab-separated reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_stats(df: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """One row for each key and statistic."""
    pairs = ", ".join(f"'{s}', cast(`{s}` as double)" for s in stats)
    return df.select(*keys, F.expr(f"stack({len(stats)}, {pairs}) as (stat, value)"))


def write_stats(df: DataFrame, keys: list[str], stats: list[str], path: str) -> None:
    """Parquet partitioned by statistic, so that reading one map prunes the others."""
    long_stats(df, keys, stats).write.mode("overwrite").option("compression", "zstd").partitionBy("stat").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
