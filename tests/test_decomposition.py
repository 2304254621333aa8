import numpy as np
import pytest

from unifold.operators import decomposition


def test_pca(spark):
    x = np.random.default_rng(0).normal(size=(300, 5)) * [5, 3, 1, 0.5, 0.1] + 2
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, x array<double>").repartition(3)
    mean, axes, values = decomposition.pca(df, "x", 5, 2)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert mean == pytest.approx(x.mean(0)) and values == pytest.approx(want[1][:2] ** 2 / 299)
    assert np.abs(axes @ want[2][:2].T) == pytest.approx(np.eye(2), abs=1e-6)
    scores = {r.id: r.scores for r in decomposition.projected(df, "x", mean, axes).collect()}
    assert scores[7] == pytest.approx(((x[7] - mean) @ axes.T).tolist())


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    for seed in range(1, 9):
        got = decomposition.kmeans(df, "x", 2, 3, seed=seed)
        if np.allclose(got, [[0, 0], [5, 5], [9, 0]], atol=0.2):
            return
    raise AssertionError(got)
