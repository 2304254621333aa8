"""Global ranks and what rests on them, on wide tables of many partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from unifold.operators import design, groups, ranking, signal


@pytest.fixture(scope="module")
def wide(spark):
    rows = 700_000
    p = F.xxhash64("id") % 100_000
    return spark.range(0, rows, 1, 64).select("id", ((p + 100_000) / 200_001).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))


def test_ranks_of_a_wide_table(spark, wide):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = ranking.global_rank(wide, ["p", "id"]).select("id", "p", "rank").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 700_000
    got = got.sort_values(["p", "id"])
    assert (got["rank"].to_numpy() == np.arange(1, len(got) + 1)).all()


def test_fdr_of_a_wide_table(spark, wide):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = ranking.fdr(wide, "p", "id").select("id", "p", "q", "wide").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = got.sort_values(["p", "id"])
    p = np.maximum(got["p"].to_numpy(), 1e-15)
    keep = p < 0.9999
    raw = p[keep] * keep.sum() / np.arange(1, keep.sum() + 1)
    want = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    assert len(got) == 700_000 and np.allclose(got["q"].to_numpy()[keep], want, rtol=1e-12, atol=0)


def test_pareto_front_of_a_wide_table(spark):
    d = spark.range(0, 200_000, 1, 32).select(F.col("id"), (F.xxhash64("id") % 50_000).alias("x"), (F.xxhash64("id", F.lit(1)) % 50_000).alias("y"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    got = groups.pareto_front(d, "x", "y").select("x", "y").toPandas()
    all_ = d.select("x", "y").toPandas().groupby("x")["y"].min().reset_index().sort_values("x")
    best = np.minimum.accumulate(all_["y"].to_numpy())
    front = all_[np.concatenate([[True], all_["y"].to_numpy()[1:] < best[:-1]])]
    assert sorted(map(tuple, got.drop_duplicates().to_numpy().tolist())) == sorted(map(tuple, front.to_numpy().tolist()))


def test_empirical_cutoffs_and_threshold(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(21, 400))
    frame = pd.DataFrame([(p, e, float(t[p, e])) for p in range(21) for e in range(400)], columns=["perm", "e", "t"])
    got = {r.level: r.cutoff for r in ranking.empirical_cutoffs(spark.createDataFrame(frame), [0.05, 0.013], 1).collect()}
    for level, cut in got.items():
        assert cut == pytest.approx(np.quantile(t[1:], 1 - level), abs=1e-12)
    none = ranking.fdr_threshold(spark.createDataFrame([(0.9, 1), (0.8, 2), (None, 3)], "p double, id int"), "p", "id").first()
    assert none.threshold == 0.0


def test_label_swaps_are_all_different(spark):
    rows = ranking.label_swaps(spark, [0, 1, 1, 0, 0]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.perm, []).append((r.unit, r.b))
    ways = {tuple(sorted(v)) for v in by.values()}
    assert len(by) == len(ways) == 10 and sorted(by[0]) == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 0)]


def test_folds_drawn_by_seed(spark):
    got = design.folds(spark, list(range(12)), 4, most=20, seed=3).toPandas()
    tests = got[got["test"]].groupby("fold")["run"].apply(tuple)
    assert len(tests) == len(set(tests)) == 20 and all(len(x) == 4 for x in tests)


def test_clusters_of_a_random_field(spark):
    rng = np.random.default_rng(4)
    field = rng.random((7, 8, 3)) < 0.35
    cells = [(int(a), int(b), int(c)) for a, b, c in np.argwhere(field)]
    label = {x: x for x in cells}
    again = True
    while again:
        again = False
        for a, b, c in cells:
            for n in ((a - 1, b, c), (a + 1, b, c), (a, b - 1, c), (a, b + 1, c), (a, b, c - 1), (a, b, c + 1)):
                if n in label and label[n] < label[a, b, c]:
                    label[a, b, c], again = label[n], True
    d = spark.createDataFrame([(a, b, c, 1.0) for a, b, c in cells], "x int, y int, z int, v double")
    got = {(r.x, r.y, r.z): tuple(r.cluster) for r in signal.clusters(d, ["x", "y", "z"], "v", 0.5).collect()}
    assert got == label


def test_savgol_weights():
    assert np.allclose(np.array(signal.savgol_weights(5, 2)) * 35, [-3, 12, 17, 12, -3])


def test_periodogram(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=50) + 3
    got = signal.periodogram(spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(y)], "s int, t int, y double"), ["s"], "t", "y", 50, 2.0).orderBy("k").toPandas()
    power = np.abs(np.fft.rfft(y - y.mean())) ** 2 * 2.0 / 50 * 2
    power[-1] /= 2
    assert np.allclose(got["power"], power[1:]) and np.allclose(got["hz"], np.fft.rfftfreq(50, 2.0)[1:])
