"""Distributions, expressions and operators with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unifold.functions import distributions as d
from unifold.functions import expressions
from unifold.operators import groups, linear, ranking, series


def test_tails():
    assert d.t_two_sided([2.0, 0.0, -2.0], [10, 3, 10]) == pytest.approx([0.07338803477074043, 1.0, 0.07338803477074043], abs=1e-12)
    assert d.f_upper([4.0], 2, 10) == pytest.approx([1.8 ** -5], abs=1e-12)
    assert d.normal_quantile([0.025]) == pytest.approx([1.959963984540054], abs=1e-10)


def test_tails_as_columns(spark):
    r = spark.range(1).select(d.t_to_p(F.lit(2.0), F.lit(10)).alias("p"), d.t_to_z(F.lit(2.0), F.lit(1e6)).alias("z")).first()
    assert r.p == pytest.approx(0.07338803477074043, abs=1e-12) and r.z == pytest.approx(2.0, abs=1e-4)


def test_expression_rejects_what_it_does_not_know():
    with pytest.raises(ValueError):
        expressions.compiled("__import__(1)", {"a": None})
    with pytest.raises(ValueError):
        expressions.compiled("a.b", {"a": None})


def test_ols_recovers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.01 * rng.normal(size=200)
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "g int, a double, b double, c double, y double")
    r = linear.ols(df, ["g"], ["a", "b", "c"], "y", {"a-b": [1, -1, 0]}).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0][1:]
    assert list(r.beta) == pytest.approx(list(want), abs=1e-9)
    assert r.r2 > 0.99 and r.contrast_t[0] > 100 and r.dof == 196


def test_states(spark):
    states = [0, 0, 0, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate(states)], "k int, t int, s int")
    life = {r.s: (r.visits, r.lifetime) for r in series.mean_lifetime(df, ["k"], ["t"], "s").collect()}
    assert life == {0: (2, 2.5), 1: (2, 1.5)}
    occ = {r.s: r.occupancy for r in series.occupancy(df, ["k"], "s").collect()}
    assert occ == {0: 5 / 8, 1: 3 / 8}


def test_fdr_masks(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, float("nan")), (4, 1.0), (5, 0.02)], "id int, p double")
    q = {r.id: r.q for r in ranking.fdr(df, "p", "id").collect()}
    assert q[1] == pytest.approx(0.02) and q[5] == pytest.approx(0.02) and q[2] is q[3] is q[4] is None


def test_sign_flips(spark):
    rows = ranking.sign_flips(spark, 6).collect()
    assert len({r.perm for r in rows}) == 64 and all(r.sign == 1 for r in rows if r.perm == 0)


def test_empty(spark):
    df = spark.createDataFrame([], "k int, t int, s int, y double")
    assert groups.one_sample_t(df, ["k"], "y").count() == 0
    assert series.mean_lifetime(df, ["k"], ["t"], "s").count() == 0
    assert linear.ols_simple(df, ["k"], "t", "y").count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
