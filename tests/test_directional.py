"""Von Mises-Fisher laws: known Bessel values, moments and divergences by sampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import directional as D


def test_bessel_functions():
    assert D.log_bessel(0, 1.0) == pytest.approx(math.log(1.2660658777520084)) and D.log_bessel(1, 2.0) == pytest.approx(math.log(1.5906368546373291))
    for x in (0.1, 3.0, 400.0):  # closed form of half orders
        assert D.log_bessel(0.5, x) == pytest.approx(0.5 * math.log(2 / (math.pi * x)) + x + math.log1p(-math.exp(-2 * x)) - math.log(2))
        assert D.bessel_ratio(3, x) == pytest.approx(1 / math.tanh(x) - 1 / x)
    for d in (2, 5, 64):
        for k in (0.5, 20.0, 300.0):
            assert D.bessel_ratio(d, k) == pytest.approx(math.exp(D.log_bessel(d / 2, k) - D.log_bessel(d / 2 - 1, k)))
            assert D.concentration(d, D.bessel_ratio(d, k)) == pytest.approx(k, rel=1e-4)
    assert D.log_constant(3, 0) == pytest.approx(-math.log(4 * math.pi)) and D.log_constant(3, 1e-6) == pytest.approx(-math.log(4 * math.pi), abs=1e-5)


@pytest.mark.parametrize("kappa", [0.5, 10.0, 200.0])
@pytest.mark.parametrize("d", [2, 5])
def test_moments_of_samples(spark, kappa, d):
    mean = np.array([3.0, -4.0, 0, 0, 0][:d])
    n = 4000
    df = spark.range(n).select("id", F.array(*[F.lit(float(x)) for x in mean]).alias("m"))
    made = df.select("id", D.sample(F.col("m"), F.lit(kappa), F.col("id"), 7).alias("s"))
    x = np.array([r["s"] for r in made.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    w = x @ (mean / 5)
    a = D.bessel_ratio(d, kappa)
    spread = math.sqrt(max(1 - a * a - (d - 1) / kappa * a, 0))
    assert abs(w.mean() - a) < 4 * spread / math.sqrt(n) and abs(w.std() - spread) < 0.1 * spread
    rest = x - np.outer(w, mean / 5)
    assert np.linalg.norm(rest.mean(0)) < 4 * math.sqrt((1 - (w**2).mean()) / n) * math.sqrt(d)
    again = np.array([r["s"] for r in df.repartition(5).select("id", D.sample(F.col("m"), F.lit(kappa), F.col("id"), 7).alias("s")).orderBy("id").collect()])
    assert (again == x).all()


def test_divergence_by_sampling():
    rng = np.random.default_rng(0)
    d, k1, k2 = 4, 8.0, 3.0
    m1, m2 = np.array([1.0, 0, 0, 0]), np.array([0.6, 0.8, 0, 0])
    x = np.array([D.one(m1, k1, rng) for _ in range(20_000)])
    terms = D.log_constant(d, k1) + k1 * x @ m1 - D.log_constant(d, k2) - k2 * x @ m2
    assert D.divergence(d, k1, k2, 0.6) == pytest.approx(terms.mean(), abs=4 * terms.std() / math.sqrt(len(x)))
    assert D.divergence(d, k1, k1, 1.0) == pytest.approx(0) and D.divergence(d, k1, 0.0, 1.0) > 0


def test_odd_rows_have_no_sample(spark):
    rows = [(1, [1.0, 0.0], 2.0), (None, [1.0, 0.0], 2.0), (3, None, 2.0), (4, [0.0, 0.0], 2.0), (5, [1.0, 0.0], None), (6, [1.0, 0.0], -1.0), (7, [1.0, None], 2.0), (8, [float("nan"), 1.0], 2.0)]
    df = spark.createDataFrame(rows, "id long, m array<double>, k double")
    got = [r["s"] for r in df.select(D.sample(F.col("m"), F.col("k"), F.col("id")).alias("s")).collect()]
    assert [x is None for x in got] == [False, False] + [True] * 6
    assert df.limit(0).select(D.sample(F.col("m"), F.col("k"), F.col("id")).alias("s")).count() == 0
