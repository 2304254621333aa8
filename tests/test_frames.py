"""Operators whose rules SQL can't tell, against NumPy."""

import numpy as np
import pytest

from unifold.operators import frames, groups


def merged(x, levels, least):
    """Sizes of the states that rows end up in, by row."""
    z = (x - x.min(0)) / np.maximum(np.ptp(x, axis=0), 1e-12)
    bins = np.minimum((z * levels).astype(int), levels - 1)
    _, of = np.unique(bins, axis=0, return_inverse=True)
    of = of.ravel()
    while len(set(of)) > 1:
        ids, sizes = np.unique(of, return_counts=True)
        small = ids[sizes.argmin()]
        if sizes.min() >= least:
            break
        mean = {i: z[of == i].mean(0) for i in ids}
        near = min((i for i in ids if i != small), key=lambda i: ((mean[i] - mean[small]) ** 2).sum())
        of[(of == small) | (of == near)] = min(small, near)
    return bins, np.array([(of == i).sum() for i in of])


@pytest.mark.parametrize("least", [1, 4, 30, 10_000])
def test_small_states_are_merged_into_the_nearest(spark, least):
    x = np.random.default_rng(least).normal(size=(400, 2))
    bins, size = merged(x, 5, least)
    df = spark.createDataFrame([*map(tuple, x.tolist()), (None, 1.0)], "a double, b double")
    rows = frames.state_bins(df, ["a", "b"], 5, least).collect()
    got = {(r.bin_a, r.bin_b): r.state_n for r in rows}
    assert got == {tuple(b): n for b, n in zip(bins.tolist(), size.tolist(), strict=True)}
    assert sum(r.n for r in rows) == 400
    assert {r.state for r in rows} == set(range(len({r.state for r in rows})))


def test_states_of_an_empty_table_and_too_many_levels(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert frames.state_bins(df, ["a", "b"], 5, 4).count() == 0
    with pytest.raises(ValueError):
        frames.state_bins(df, ["a", "b"], 1000, 4)


def test_ljung_box_lags_follow_the_length(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for key, n in enumerate((1, 2, 9, 10, 40, 300)):
        y = rng.normal(size=n)
        rows += [(key, t, float(v)) for t, v in enumerate(y)]
        h = min(2 + min(n // 8, round(3 * np.log(n))), n // 2)
        c = y - y.mean()
        q = sum((c[k:] @ c[:-k] / (c @ c)) ** 2 / (n - k) for k in range(1, h + 1)) * n * (n + 2) if n >= 10 else 0
        want[key] = (n, h, max(h - 2, 1), pytest.approx(q))
    rows += [(7, t, 2.5) for t in range(20)] + [(8, 0, None)]
    want[7] = (20, 4, 2, 0.0)
    got = frames.ljung_box(spark.createDataFrame(rows, "key int, t int, y double"), ["key"], ["t"], "y").collect()
    assert {r.key: (r.n, r.lags, r.dof, r.ljung_box) for r in got} == want


def test_volume_means_over_the_bright_entities(spark):
    x = np.random.default_rng(8).normal(size=(57, 6))
    df = spark.createDataFrame([(e, v, float(x[e, v])) for e in range(57) for v in range(6)], "e int, v int, y double")
    bright = x.mean(1) >= np.quantile(x.mean(1), 0.6)
    got = {r.v: r["mean"] for r in groups.volume_means(df, "e", "v", "y").collect()}
    assert got == {v: pytest.approx(x[bright, v].mean()) for v in range(6)}
