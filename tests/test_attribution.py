"""Shapley values by enumeration of all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import attribution as A
from tessella.operators import learn as M
from tessella.operators.learn import assembled

NAMES = ["a", "b", "c", "d"]


def _table(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 7, (n, 4)).astype(float)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 3, 5, 0) + rng.normal(0, 0.3, n)
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*NAMES, "y"]), x


def _follow(node, row, inside):
    """The value of a coalition by walking the tree."""
    if node.numDescendants() == 0:
        return node.prediction()
    f, left, right = int(node.split().featureIndex()), node.leftChild(), node.rightChild()
    if f in inside:
        return _follow(left if row[f] <= node.split().threshold() else right, row, inside)
    n = node.impurityStats().count()
    return (left.impurityStats().count() * _follow(left, row, inside) + right.impurityStats().count() * _follow(right, row, inside)) / n


def _shapley(roots, weights, row):
    value = lambda s: sum(w * _follow(r, row, s) for r, w in zip(roots, weights))
    out = []
    for j in range(4):
        rest = [i for i in range(4) if i != j]
        out.append(sum(factorial(k) * factorial(3 - k) / 24 * (value({*s, j}) - value(set(s))) for k in range(4) for s in combinations(rest, k)))
    return out, value(set())


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_values_by_all_coalitions(spark, kind):
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    df, x = _table(spark, 120, 1)
    at = {"featuresCol": "__x", "labelCol": "y", "seed": 3}
    made = {"tree": lambda: DecisionTreeRegressor(maxDepth=4, **at), "forest": lambda: RandomForestRegressor(numTrees=3, maxDepth=3, **at), "boosted": lambda: GBTRegressor(maxIter=3, maxDepth=3, stepSize=0.3, **at)}
    model = made[kind]().fit(assembled(df, NAMES, "y"))
    found = A.leaves(model)
    trees, weights = ([model], [1.0]) if kind == "tree" else (model.trees, model.treeWeights)
    weights = [w / sum(weights) for w in weights] if kind == "forest" else weights
    roots = [t._call_java("rootNode") for t in trees]
    got = A.values(x[:12], found)
    for row, values in zip(x[:12], got):
        want, nothing = _shapley(roots, weights, row)
        assert np.allclose(values, want, atol=1e-9) and A.base(found) == pytest.approx(nothing)
    rows = model.transform(assembled(df, NAMES, "y")).withColumn("phi", A.attributed(found, NAMES)).collect()
    assert all(abs(A.base(found) + sum(r["phi"]) - r["prediction"]) < 1e-9 for r in rows)


def test_selection_and_nulls(spark):
    df, _ = _table(spark, 200, 2)
    got = {r["feature"]: r["mean_abs_shap"] for r in A.shap_select(df, df, NAMES, ["y"], rounds=3, depth=3).collect()}
    assert len(got) >= 2 and "d" not in got and min(got.values()) > 0.1
    model = A.fit_boosted(df, NAMES, "y", rounds=2, depth=2)
    odd = df.limit(3).withColumn("a", F.when(F.col("b") >= 0, F.lit(None).cast("double"))).unionByName(df.limit(2).withColumn("b", F.lit(float("nan")))).unionByName(df.limit(1))
    phi = [r["p"] for r in odd.select(A.attributed(A.leaves(model), NAMES).alias("p")).collect()]
    assert phi[:5] == [None] * 5 and len(phi[5]) == 4
    assert odd.limit(0).select(A.attributed(A.leaves(model), NAMES).alias("p")).count() == 0
    alone = A.leaves(A.fit_boosted(df.withColumn("y", F.lit(2.0)), NAMES, "y", rounds=1))
    assert A.base(alone) == pytest.approx(2.0) and not A.values(np.ones((2, 4)), alone).any()


def _repeating(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (3000, 2)).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(0, 1, 3000)
    odd = [(None, 1.0, 2.0), (1.0, 1.0, None)]
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + odd, "a double, b double, y double")


def test_boosting_on_distinct_rows_is_that_of_all_rows(spark):
    from pyspark.ml.regression import GBTRegressor

    df = _repeating(spark)
    few = M.weighted(df, ["a", "b"], "y")
    assert few.count() == 25 and few.agg(F.sum("__w")).first()[0] == 3000
    want = GBTRegressor(featuresCol="__x", labelCol="y", maxIter=4, maxDepth=3, stepSize=0.3, seed=1).fit(assembled(df, ["a", "b"], "y"))
    got = A.fit_boosted(df, ["a", "b"], "y", rounds=4, depth=3, rate=0.3, seed=1)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray()) and A.base(A.leaves(got)) == pytest.approx(A.base(A.leaves(want)))
    grid = np.array([(i, j) for i in range(5) for j in range(5)], float)
    assert np.allclose(A.values(grid, A.leaves(got)), A.values(grid, A.leaves(want)))


def test_net_on_distinct_rows_is_that_of_all_rows(spark, monkeypatch):
    df = _repeating(spark)
    got = M.fit_net(df, ["a", "b"], "y", (4,), 5)
    monkeypatch.setattr(M, "REPEATS", 10**9)
    want = M.fit_net(df, ["a", "b"], "y", (4,), 5)
    assert all(np.allclose(p, q) for g, w in zip(got.layers, want.layers) for p, q in zip(g, w))


def test_forest_on_the_draws_of_distinct_rows(spark, monkeypatch):
    df = _repeating(spark)
    drawn = M.bootstrapped(df.dropna(), ["a", "b"], "y", 3, 7).toPandas()
    own = df.dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).toPandas().set_index(["a", "b"])
    assert len(drawn) == 25 and all(abs(drawn[f"w{k}"].sum() - 3000) < 5 * 3000**0.5 for k in range(3)) and (drawn["w0"] != drawn["w1"]).any()
    both = drawn.set_index(["a", "b"]).join(own)
    assert (abs(both["w0"] - both["n"]) < 6 * both["n"] ** 0.5).all() and np.allclose(both["y0"] / both["w0"], both["s"] / both["n"], atol=0.8)
    got = M.importances(df, ["a", "b"], ["y"], trees=6, depth=3)
    monkeypatch.setattr(M, "REPEATS", 10**9)
    want = M.importances(df, ["a", "b"], ["y"], trees=6, depth=3)
    assert sum(got.values()) == pytest.approx(1.0) and abs(got["a"] - want["a"]) < 0.35


def test_random_features_by_batch_are_the_expressions(spark):
    df = spark.createDataFrame([([0.5, -1.0, 2.0],), ([0.0, 0.0, 0.0],), (None,)], "v array<float>")
    rows = df.select(M.random_vector(F.col("v"), 3, 5, 0.7).alias("p"), F.array(*M.random_features(F.col("v"), 3, 5, 0.7)).alias("q")).collect()
    assert all(np.allclose(r["p"], r["q"]) for r in rows[:2]) and rows[2]["p"] is None
