"""Kernel components and tangent spaces against whole matrices in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import manifold as M


def _full(x, gamma, width):
    k = np.exp(-gamma * ((x[:, None] - x) ** 2).sum(2))
    c = k - k.mean(0) - k.mean(0)[:, None] + k.mean()
    values, vectors = np.linalg.eigh(c)
    return c, (vectors[:, ::-1] * np.sqrt(np.maximum(values[::-1], 0)))[:, :width], values[::-1][:width]


def test_all_landmarks_are_kernel_pca_and_fewer_come_near(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (2, 0, 1), (0, 2, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<float>")
    x = x.astype(np.float32).astype(float)
    _, want, values = _full(x, 0.5, 4)
    got, found = M.kernel_components(df, "i", "v", 4, 0.5, landmarks=180)
    y = np.array([r["y"] for r in df.select("i", got.alias("y")).orderBy("i").collect()])
    assert np.allclose(found, values) and np.allclose(np.abs(y), np.abs(want), atol=1e-6)
    gram = want @ want.T
    errors = []
    for m in (12, 60):
        got, _ = M.kernel_components(df, "i", "v", 4, 0.5, landmarks=m)
        z = np.array([r["y"] for r in df.select("i", got.alias("y")).orderBy("i").collect()])
        z = z - z.mean(0)
        errors.append(np.linalg.norm(z @ z.T - gram) / np.linalg.norm(gram))
    assert errors[1] < errors[0] < 0.5 and errors[1] < 0.15
    odd = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, None)], "i long, v array<float>")
    assert [r["y"] is None for r in odd.select("i", got.alias("y")).orderBy("i").collect()] == [False, True]
    assert M.kernel_components(df.limit(0), "i", "v", 4, 0.5)[1].size == 0


@pytest.mark.parametrize("singular", [False, True])
def test_mean_and_tangents_by_loops(spark, singular):
    rng = np.random.default_rng(1)
    rows = []
    for win in range(40):
        a = rng.normal(size=(3, 3))
        x = rng.normal(size=(4 if singular else 25, 3)) @ a
        if singular and win % 3 == 0:
            x[:, 2] = x[:, 0]
        rows += [(win, t, *map(float, r)) for t, r in enumerate(x)]
    df = spark.createDataFrame(rows + [(99, 0, None, 1.0, 1.0)], "win long, t long, a double, b double, c double")
    held = M.covariances(df, ["win"], ["a", "b", "c"], eps=1e-6).cache()
    by = {r["win"]: np.array(r["m"]).reshape(3, 3) for r in held.collect()}
    for win, m in by.items():
        x = np.array([r[2:] for r in rows if r[0] == win])
        assert np.allclose(m, np.cov(x.T) + 1e-6 * np.eye(3))
    assert sorted(by) == list(range(40))
    got = M.geometric_mean(held, "m", 3)
    m = np.array(list(by.values()))
    assert np.linalg.norm(M.logarithms(m, got).mean(0)) < 1e-6  # the mean's own condition
    low = np.linalg.eigvalsh(got)
    assert low.min() > 0
    vectors = np.array([r["v"] for r in held.select(M.tangent("m", got).alias("v")).collect()])
    assert vectors.shape == (40, 6) and np.allclose(vectors.mean(0), 0, atol=1e-6)
    # lengths are distances from the mean: the root of the summed squared log eigenvalues of mean^-1 m
    for m, v in zip([np.array(r["m"]).reshape(3, 3) for r in held.collect()], vectors):
        assert np.isclose(np.linalg.norm(v), np.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(got, m)).real) ** 2).sum()), rtol=1e-4)


def test_one_matrix_is_its_own_mean(spark):
    df = spark.createDataFrame([(1, [2.0, 0.5, 0.5, 1.0])], "i long, m array<double>")
    assert np.allclose(M.geometric_mean(df, "m", 2), [[2, 0.5], [0.5, 1]])
    assert np.allclose(M.geometric_mean(df.limit(0), "m", 2), np.eye(2))
    assert df.withColumn("m", F.lit(None).cast("array<double>")).select(M.tangent("m", np.eye(2)).alias("v")).first()["v"] is None
