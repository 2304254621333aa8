"""Decompositions: Gram matrices summed by Spark, small solves on the driver, one pass per iteration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, array: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) of an array column of ``width`` doubles, one partial sum for each task."""

    def run(batches):
        n, s, g = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column(0), width)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["n", "s", "g"])

    parts = df.select(array).where(F.size(array) == width).mapInArrow(run, "n long, s array<double>, g array<double>")
    n, s, g = 0, np.zeros(width), np.zeros(width * width)
    for r in parts.repartition(8).mapInArrow(lambda bs: _added(bs, width), "n long, s array<double>, g array<double>").toLocalIterator():
        n, s, g = n + r.n, s + np.array(r.s), g + np.array(r.g)
    return n, s, g.reshape(width, width)


def _added(batches, width: int):
    n, s, g = 0, np.zeros(width), np.zeros(width * width)
    for b in batches:
        n += sum(b.column(0).to_pylist())
        s += _matrix(b.column(1), width).sum(0)
        g += _matrix(b.column(2), width * width).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.tolist()])], names=["n", "s", "g"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def pca(df: DataFrame, array: str, width: int, components) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes as rows, variances). ``components``: a number, or a share of variance below 1. The largest element of each axis is positive."""
    n, s, g = gram(df, array, width)
    mean = s / max(n, 1)
    values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(values)[::-1]
    values, axes = np.maximum(values[order], 0), vectors[:, order].T
    axes *= np.sign(axes[np.arange(width), np.abs(axes).argmax(1)])[:, None]
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), components) + 1) if components < 1 else int(components)
    return mean, axes[:k], values[:k]


def projected(df: DataFrame, array: str, mean: np.ndarray, axes: np.ndarray, out: str = "scores") -> DataFrame:
    """The scores of each row on the axes, as an array column. Map-only."""
    share = df.sparkSession.sparkContext.broadcast((mean, axes))
    at, width = df.columns.index(array), len(mean)
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    def run(batches):
        m, a = share.value
        for b in batches:
            x = (_matrix(b.column(at), width) - m) @ a.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType(list(df.schema.fields)).add(out, ArrayType(DoubleType())))


def kmeans(df: DataFrame, array: str, width: int, k: int, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Centres by Lloyd's method from the first rows by hash; each round sums within tasks and moves k rows per task."""
    start = df.select(array).orderBy(F.xxhash64(F.col(array), F.lit(seed))).limit(k).collect()
    centres = np.array([r[0] for r in start], float)
    for _ in range(rounds):
        share = df.sparkSession.sparkContext.broadcast(centres)

        def run(batches, share=share):
            c = share.value
            n, s = np.zeros(len(c)), np.zeros(c.shape)
            for b in batches:
                x = _matrix(b.column(0), width)
                own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1) if len(x) * len(c) * width < 4_000_000 else np.array([((c - v) ** 2).sum(1).argmin() for v in x])
                n += np.bincount(own, minlength=len(c))
                np.add.at(s, own, x)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(n), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["k", "n", "s"])

        sums = df.select(array).mapInArrow(run, "k int, n double, s array<double>").select("k", "n", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        new = centres.copy()
        for r in sums:
            if r.n:
                new[r.k, r.i] = r.v / r.n
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres[np.lexsort(centres.T[::-1])]
