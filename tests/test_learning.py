"""Readers, samples, models, filters and streaming forms against plain numpy or literal rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import learn as M
from tessella.operators import sampling as P
from tessella.operators import signal as X
from tessella.sources import files as R
from tessella.streaming import panels


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [1, 2, 3, 0.5] + 1000
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(7)


def test_moments_are_those_of_numpy_and_skip_nulls(spark, points):
    x, df = points
    more = df.unionByName(spark.createDataFrame([(900, None), (901, [1.0, None, 2.0, 3.0])], "id bigint, v array<double>"))
    m = M.moments(more, F.col("v"))
    assert m.n == 300
    np.testing.assert_allclose(m.mean, x.mean(0))
    np.testing.assert_allclose(m.cov, np.cov(x.T, bias=True), rtol=1e-8)
    assert M.moments(df.limit(0), F.col("v")).n == 0


def test_ridge_and_components(points):
    x, df = points
    coef, intercept = M.ridge(M.moments(df, F.col("v")), 1.0)
    a, y = x[:, :3] - x[:, :3].mean(0), x[:, 3]
    np.testing.assert_allclose(coef[:, 0], np.linalg.solve(a.T @ a + np.eye(3), a.T @ (y - y.mean())), rtol=1e-6)
    np.testing.assert_allclose(intercept[0], y.mean() - x[:, :3].mean(0) @ coef[:, 0], rtol=1e-6)
    _, shares = M.components(M.moments(df, F.col("v")))
    np.testing.assert_allclose(shares, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1] / np.trace(np.cov(x.T)), rtol=1e-6)
    assert M.components_for(np.array([0.5, 0.45, 0.05]), 0.95) == 2


def test_frechet_of_a_shift_is_its_square(points):
    _, df = points
    a = M.moments(df, F.col("v"))
    b = M.moments(df, F.transform("v", lambda x: x + 2.0))
    assert M.frechet(a, a) == pytest.approx(0, abs=1e-6) and M.frechet(a, b) == pytest.approx(16.0, rel=1e-6)


def test_random_features_approach_the_kernel(points):
    x, df = points
    rows = df.select("id", F.transform("v", lambda v: (v - 1000) / 3).alias("v"))
    side = (F.col("id") >= 150).cast("int")
    z = (x - 1000) / 3
    k = np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(-1))
    exact = k[:150, :150].mean() + k[150:, 150:].mean() - 2 * k[:150, 150:].mean()
    assert M.mmd_rbf(rows, F.col("v"), 4, side, 0.5, features=128).first()[0] == pytest.approx(exact, abs=0.02)


def test_positions_tiles_and_bootstrap(spark):
    df = spark.range(3, 1003, 3).withColumn("id", F.col("id") * F.col("id")).repartition(5)
    rows, n = P.positions(df, "id")
    got = rows.withColumn("part", P.tile(F.col("pos"), n, 7)).orderBy("id").collect()
    assert n == 334 and [r["pos"] for r in got] == list(range(334))
    assert [sum(r["part"] == k for r in got) for k in range(7)] == [48, 48, 48, 48, 48, 47, 47]
    assert P.bootstrap(df, "id", 0.5, 1).collect().__len__() == 167
    assert P.positions(df.limit(0), "id")[1] == 0 and not P.bootstrap(df.limit(0), "id", 0.5, 1).collect()
    assert sorted(P.bootstrap(df, "id", 0.5, 1).collect()) == sorted(P.bootstrap(df.repartition(2), "id", 0.5, 1).collect())


def test_binned_information(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"), F.xxhash64("id").cast("double").alias("c"))
    assert M.mutual_info_binned(df, "a", "b") == pytest.approx(np.log(10), rel=0.02)
    assert M.mutual_info_binned(df, "a", "c") < 0.1


def test_cluster_score_matches_its_formula(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(8, 1, (60, 2))])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got = M.cluster_score(df, "v", [[0.0, 0.0], [8.0, 8.0]])
    own = (x.sum(1) > 8).astype(int)
    c = np.array([x[own == k].mean(0) for k in (0, 1)])
    inside = sum(((x[own == k] - c[k]) ** 2).sum() for k in (0, 1))
    between = sum((own == k).sum() * ((c[k] - x.mean(0)) ** 2).sum() for k in (0, 1))
    assert got["calinski_harabasz"] == pytest.approx(between / (inside / 98))
    assert M.cluster_score(df, "v", [[0.0, 0.0]])["davies_bouldin"] == -1


@pytest.mark.parametrize("n, depth", [(40, 5), (300, 8), (6000, 12)])
def test_forest_has_the_references_size(spark, monkeypatch, n, depth):
    from pyspark.ml.regression import RandomForestRegressor as R

    asked, fit = [], R.fit
    monkeypatch.setattr(R, "fit", lambda self, df: asked.append(self) or fit(self.copy({self.numTrees: 3}), df))
    df = spark.range(n).select((F.col("id") % 17).cast("double").alias("a"), F.col("id").cast("double").alias("b"), F.sin(F.col("id") / 9).alias("y"))
    holes = spark.createDataFrame([(None, 1.0, 1.0), (1.0, 1.0, None)] * 40, df.schema)
    assert M.fit_predict(df.unionByName(holes), df, ["a", "b"], "y", "random_forest").count() == n
    (m,) = asked
    assert (m.getNumTrees(), m.getMaxDepth(), m.getMinInstancesPerNode(), m.getFeatureSubsetStrategy()) == (100, depth, 2, "sqrt")
    assert m.getSubsamplingRate() == min(5000, n) / n


def test_pchip_is_monotone_and_hits_its_points():
    x, y = np.array([0.0, 1, 3, 4, 8]), np.array([0.0, 0, 2, 5, 5])
    np.testing.assert_allclose(X.pchip(x, y, x), y, atol=1e-12)
    fine = X.pchip(x, y, np.linspace(0, 8, 400))
    assert (np.diff(fine) >= -1e-12).all() and np.isnan(X.pchip(x, y, np.array([-1.0, 9.0]))).all()
    np.testing.assert_allclose(X.pchip(x[:2], np.array([1.0, 3.0]), np.array([0.5])), [2.0])


def test_filters_keep_what_they_should():
    t = np.arange(256)
    slow, fast = np.sin(2 * np.pi * t / 64), 0.3 * np.sin(2 * np.pi * t / 4)
    assert np.abs(X.butterworth_gain(slow + fast + 3, 0.0, 0.08) - slow - 3).max() < 0.01
    assert np.abs(X.butterworth_gain(slow + fast + 3, 0.1, 0.4) - fast).max() < 0.05
    np.testing.assert_allclose(X.spectral_mask(slow + 0.1 * fast, 0.2), slow, atol=1e-9)
    np.testing.assert_allclose(X.recursive(np.array([8.0]), np.array([0.5]), 3), [4, 2, 1])


def test_readers(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "b.csv").write_text("x,y\n5,6\n")
    (tmp_path / "pages" / "a.csv").write_text("x,y\n1,2\n3,\n")
    pages = R.csv_pages(spark, str(tmp_path / "pages"), "x double, y double")
    assert sorted(map(tuple, pages.collect()), key=str) == [(0, 0, 1.0, 2.0), (0, 1, 3.0, None), (1, 0, 5.0, 6.0)]
    padded = sorted(map(tuple, R.pad_pages(pages, ["x", "y"]).collect()))
    assert padded == [(0, 0, 1.0, 2.0), (0, 1, 3.0, 0.0), (1, 0, 5.0, 6.0), (1, 1, 0.0, 0.0)]
    (tmp_path / "t.tsv").write_text("7\t1\t2\n-1\t3\tNaN\n7\t5\t5\n")
    rows = sorted(R.labelled_tsv(spark, str(tmp_path / "t.tsv")).collect(), key=lambda r: r["line"])
    assert [r["label"] for r in rows] == [1, 0, 1] and rows[0]["values"] == [1.0, 2.0]
    (tmp_path / "s.csv").write_text("a\n" + "\n".join(str(i) for i in range(1, 8)) + "\n")
    assert sorted(r[0] for r in R.csv_stride(spark, str(tmp_path / "s.csv"), 3, "a int").collect()) == [2, 3, 5, 6]
    assert R.csv_stride(spark, str(tmp_path / "s.csv"), 1, "a int").count() == 7
    with pytest.raises(ValueError, match="positive"):
        R.csv_stride(spark, str(tmp_path / "s.csv"), 0, "a int")


def test_relational_arff(spark, tmp_path):
    head = "% made\n@relation r\n@attribute rel relational\n  @attribute t0 numeric\n@end rel\n@attribute class {b,a}\n\n@DATA\n"
    (tmp_path / "train.arff").write_text(head + "'1.0,2.0\\n5,5',b\n\"3,?\\n5,5\", 'a'\nnot a series\n")
    (tmp_path / "test.arff").write_text(head + "'4.0,NaN,x\\n6,7\\n1,1',b\n")
    (tmp_path / "none.arff").write_text(head)
    train = R.relational_arff(spark, str(tmp_path / "train.arff"))
    rows = sorted(train.collect(), key=lambda r: r["line"])
    assert [(r["line"], r["label"], r["values"]) for r in rows] == [(8, 1, [[1.0, 2.0], [5.0, 5.0]]), (9, 0, [[3.0, None], [5.0, 5.0]])]
    own = sorted(R.standardized(train, train).collect(), key=lambda r: r["line"])
    sd = np.std([1, 2, 3])
    assert np.allclose(own[0]["values"], [[-1 / sd, 0], [0, 0]]) and own[1]["values"][0][1] is None and np.isclose(own[1]["values"][0][0], 1 / sd)
    other = R.standardized(R.relational_arff(spark, str(tmp_path / "test.arff")), train).first()["values"]
    assert np.isclose(other[0][0], 2 / sd) and np.isnan(other[0][1]) and other[0][2] is None and other[1:] == [[1.0, 2.0], [None, None]]
    none = R.relational_arff(spark, str(tmp_path / "none.arff"))
    assert none.count() == 0 and R.standardized(train, none).filter("values[0][0] is not null").count() == 0


def test_line_numbers_hold_over_splits(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = R.numbered_lines(spark, str(tmp_path / "n.txt"))
        assert rows.filter(F.col("line") != F.col("value").cast("bigint")).count() == 0 and rows.count() == 5000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_npy_cubes(spark, tmp_path):
    cube = np.arange(5 * 3 * 2, dtype=np.float32).reshape(5, 3, 2)
    np.save(tmp_path / "c.npy", cube)
    spark.dataSource.register(R.NpyCube)
    rows = spark.read.format("npy").option("path", str(tmp_path / "c.npy")).option("rows", 2).load().orderBy("page", "step").collect()
    assert np.array([r["values"] for r in rows]).reshape(cube.shape).tolist() == cube.tolist()


def test_streams_give_the_rows_of_a_batch(spark, tmp_path):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), "a" if i % 3 else "b", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def answer(out, mode, name):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert answer(panels.calendar(stream, "1 hour", "10 minutes"), "complete", "cal") == sorted(map(tuple, panels.calendar(df, "1 hour", "10 minutes").collect()))
    assert answer(panels.sessions(stream, "20 minutes", "10 minutes"), "complete", "ses") == sorted(map(tuple, panels.sessions(df, "20 minutes", "10 minutes").collect()))
    means = {e: m for _, e, m in answer(panels.trailing_mean(stream, 3), "append", "mean")}
    assert means[0] == 0 and means[4] == 2 and means[39] == 37


def test_forest_grows_on_its_draws(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 40, (3000, 2)).astype(float), rng.normal(size=3000)
    y += np.where(x[:, 0] > 20, 10.0, 0.0) + 5 * (x[:, 1] == 7)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double").repartition(3)
    forest = M.fit_forest(df, ["a", "b"], "y", trees=30, draws=400)
    again = M.fit_forest(df, ["a", "b"], "y", trees=30, draws=400)
    assert len(forest) == 30 and all((t.value == u.value).all() and (t.cut == u.cut).all() for t, u in zip(forest, again, strict=True))
    done = df.withColumn("p", M.forest_predict(forest, ["a", "b"])).toPandas()
    assert np.sqrt(((done.p - done.y) ** 2).mean()) < 1.4 < done.y.std() / 3
    # one tree without chance: the cut of least squares, midway, both sides of the least size
    one = M.grown(np.array([[1.0], [2.0], [3.0], [10.0], [11.0], [90.0]]), np.array([0.0, 0, 0, 4, 4, 50]), 1, 2, 1, np.random.default_rng(0))
    assert one[1][0] == 10.5 and sorted(one[4][1:]) == pytest.approx([1.0, 27.0])
    deep = M.grown(x, y, 3, 2, 2, np.random.default_rng(1))
    tree = M.Tree(np.array(deep[0]), np.array(deep[1]), np.array(deep[2]), np.array(deep[3]), np.array(deep[4]))
    assert len(np.unique(tree.predict(x))) <= 8 and (M.Tree(np.array([0]), np.array([np.inf]), np.array([0]), np.array([0]), np.array([3.0])).predict(x) == 3).all()
    with pytest.raises(ValueError):
        M.fit_forest(df.limit(0), ["a", "b"], "y")
