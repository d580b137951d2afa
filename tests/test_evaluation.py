"""Metrics, ranks, padding, forecasts and fitted models on literal rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import encode, grouped, learn, metrics, sampling, series, vectors
from tessella.sources import files
from tessella.spec import SeriesSpec

SPEC = SeriesSpec(("k",), ("t",))


def test_metrics_leave_nulls_out_and_bear_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, None), (None, 1.0)], "y double, p double")
    got = df.agg(metrics.mse("y", "p").alias("mse"), metrics.mae("y", "p").alias("mae"), metrics.r2("y", "p").alias("r2"), metrics.rmse("y", "p").alias("rmse"), metrics.nrmse("y", "p").alias("nrmse")).first()
    assert got["mse"] == 0.5 and got["mae"] == 0.5 and got["r2"] == 0.5 and abs(got["rmse"] - math.sqrt(0.5)) < 1e-12 and abs(got["nrmse"] - math.sqrt(0.5) / 2) < 1e-12
    flat = spark.createDataFrame([(1.0, 2.0)], "y double, p double").agg(metrics.r2("y", "p"), metrics.nrmse("y", "p")).first()
    assert flat[0] is None and flat[1] is None
    assert df.limit(0).agg(metrics.mse("y", "p")).first()[0] is None


def test_ranks_and_quantiles_share_ties(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, None, 9.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r["i"]: r["r"] for r in sampling.average_ranks(df, "v", "r").collect()}
    assert got == {0: 5.0, 1: 1.5, 2: 5.0, 3: 3.0, 4: 5.0, 5: None, 6: 7.0, 7: 1.5}
    known = [v for v in values if v is not None]
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        assert abs(sampling.quantile(df, "v", q) - np.quantile(known, q)) < 1e-12
    assert sampling.quantile(df.limit(0), "v", 0.5) is None


def test_labels_are_numbered_in_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("ab",), ("é",), ("",), ("b",)], "s string")
    got = [(r["s"], r["code"]) for r in encode.label_encode(df, "s", "code").collect()]
    assert sorted(set(got), key=str) == sorted({("", 0), ("a", 1), ("ab", 2), ("b", 3), ("é", 4), (None, None)}, key=str) and len(got) == 7


def test_a_query_set_meets_every_row_once(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 3) for i in range(40)], "vec_id long, embedding array<double>, label int")
    for block in (1, 3, 512):
        got = sorted((r["i"], r["j"]) for r in vectors.met(df.filter("vec_id % 10 = 0"), df, block=block).collect())
        assert got == sorted((i, j) for i in range(0, 40, 10) for j in range(40) if i != j)
    assert vectors.met(df.limit(0), df).count() == 0 and vectors.met(df, df.limit(0)).count() == 0


def test_padding_and_centring(spark):
    nan = float("nan")
    df = spark.createDataFrame([([nan, nan, 1.0, 2.0, nan],), ([1.0, 2.0, 3.0, 4.0, 5.0],), ([nan, nan],), ([nan, 7.0],)], "x array<double>")
    said = lambda a: [None if math.isnan(v) else v for v in a]
    centred = [said(r[0]) for r in df.select(series.centre_series(F.col("x"))).collect()]
    assert centred == [[None, 1.0, 2.0, None, None], [1.0, 2.0, 3.0, 4.0, 5.0], [None, None], [7.0, None]]
    padded = [said(r[0]) for r in df.select(series.pad_nan(F.col("x"), 5, True)).collect()]
    assert padded[2:] == [[None] * 5, [None, None, 7.0, None, None]] and padded[1] == [1.0, 2.0, 3.0, 4.0, 5.0]
    parts = [[said(s) for s in r[0]] for r in df.select(series.split_with_nan(F.col("x"), 3)).collect()]
    assert parts[1] == [[1.0, 2.0], [3.0, 4.0], [5.0, None]] and parts[3] == [[None], [7.0], [None]]


def test_forecasts_feed_on_themselves(spark):
    y = [1.0]
    for _ in range(20):
        y.append(0.5 * y[-1] + 3.0)
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(y)] + [("b", t, 4.0) for t in range(5)] + [("c", 0, 1.0)], "k string, t int, v double")
    got = {(r["k"], r["step"]): r["forecast"] for r in series.recursive_forecast(df, SPEC, "v", 3).collect()}
    want = y[-1]
    for step in (1, 2, 3):
        want = 0.5 * want + 3.0
        assert abs(got["a", step] - want) < 1e-9 and got["b", step] == 4.0 and got["c", step] is None


def test_spectrum_and_alarms_by_definition(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=21)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)] + [("b", 0, 2.0)], "k string, t int, v double")
    spec = SeriesSpec(("name",), ("t",))
    got = {(r["name"], r["k"]): r["power"] for r in series.spectrum(df.withColumnRenamed("k", "name"), spec, "v").collect()}
    x = y - y.mean()
    want = {("a", k): abs(sum(v * np.exp(-2j * np.pi * k * t / 21) for t, v in enumerate(x))) ** 2 for k in range(1, 11)} | {("b", 1): 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    alarms = spark.createDataFrame([("a", t, t in (1, 2, 3, 6, 9)) for t in range(12)], "k string, t int, alarm boolean")
    assert sorted(r["rn"] for r in series.alarm_suppress(alarms, SPEC, "alarm", 3).collect()) == [1, 2, 6]


def test_warping_by_the_plain_recursion():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (1, 5), (4, 7), (9, 3), (12, 12)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        cost = np.full((n + 1, m + 1), np.inf)
        cost[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
        assert abs(grouped.dtw_distance(a, b) - math.sqrt(cost[n, m])) < 1e-12
    assert grouped.dtw_distance(np.empty(0), np.empty(0)) == 0.0


def test_planes_and_clusters_and_nets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    side = np.where(np.arange(400) % 2, 6.0, -6.0)
    rows = [(i, float(a + s), float(b), float(2 * a - b + 3 * s + 1), float(np.sin(2 * a) + b * b), "k") for i, ((a, b), s) in enumerate(zip(x, side))]
    df = spark.createDataFrame(rows, "i int, p double, q double, y double, z double, key string")
    flat = encode.plane(df.filter("p > 0"), ["key"], "y", "p", "q").first()
    assert abs(flat["first"] - 2) < 1e-9 and abs(flat["second"] + 1) < 1e-9
    train, test = df.filter("i % 4 <> 0"), df.filter("i % 4 = 0")
    assert learn.fit_per_cluster(train, test, ["p", "q"], "y", 2, 1e-6).agg(metrics.rmse("y", "prediction")).first()[0] < 0.05
    labelled = df.withColumn("v", F.array("p")).withColumn("t", F.signum("p"))
    assert learn.cluster_and_label(labelled.filter("i % 4 <> 0"), labelled.filter("i % 4 = 0"), "v", "t", 2).agg(metrics.rmse("t", "prediction")).first()[0] < 0.05
    centred = df.withColumn("p", F.col("p") - F.when(F.col("i") % 2 == 1, 6.0).otherwise(-6.0))
    net = learn.fit_net(centred, ["p", "q"], "z", epochs=120, rate=0.05)
    spread = centred.agg(F.stddev_pop("z")).first()[0]
    assert learn.net_predict(centred, net, ["p", "q"]).agg(metrics.rmse("z", "prediction")).first()[0] < 0.5 * spread
    assert learn.net_predict(centred.withColumn("p", F.lit(None).cast("double")), net, ["p", "q"]).filter("prediction is not null").isEmpty()
    kept = learn.importance_select(centred.withColumn("noise", F.rand(1)), ["p", "q", "noise"], ["z"])
    assert {c for c, _ in kept} == {"p", "q"} and [c for c, _ in learn.rfe(centred.withColumn("noise", F.rand(1)), ["p", "q", "noise"], "z", 0.7)] and len(learn.tune_grid(df, ["p", "q"], "y", {"regParam": [0.0, 10.0]})) == 2


def test_logs_and_caches(spark, tmp_path):
    assert files.run_log(spark, str(tmp_path / "none")).count() == 0
    runs = spark.createDataFrame([("d", "metrics", "m", 1, [0.5]), ("d", "metrics", "m", 0, [0.25, 1.0]), ("d", "times", "m", 0, [2.0])], "dataset string, kind string, method string, run int, values array<double>")
    for _ in range(2):
        files.log_runs(runs.filter("run = 0") if _ else runs.filter("run = 1"), str(tmp_path / "log"))
    assert json.loads(files.run_log(spark, str(tmp_path / "log")).first()["log"]) == {"metrics": {"m": [[0.25, 1.0], [0.5]]}, "times": {"m": [[2.0]]}}
    made = []

    def make():
        made.append(1)
        return {"x": spark.range(3), "y": spark.range(2)}

    for use in (False, False, True):
        held = files.cached(spark, str(tmp_path / "cache"), make, use)
    assert len(made) == 2 and held["x"].count() == 3 and held["y"].count() == 2


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://there"

    with pytest.raises(ValueError):
        files.scratch(Elsewhere, "x")


def test_direct_models_read_the_rows_once_and_whole_pages(spark):
    """Pages of 1 to 600 rows, nulls among them: ridge by numpy, and no row read twice."""
    from tessella.plans import evaluation_queries

    rng = np.random.default_rng(5)
    rows = [(u * 1000 + k, k, u, None if (u + k) % 17 == 0 and k else float(v)) for u in range(60) for k, v in enumerate(rng.normal(10, 3, 600 if u == 7 else 1 + u % 9))]
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    class Given:
        events = spark.createDataFrame(rows, "event_id long, ts int, user_id long, value double").mapInArrow(told, "event_id long, ts int, user_id long, value double")

    Given.spark = spark
    got = {(r["view"], r["model"]): r["rmse"] for r in evaluation_queries.eval_direct(Given).collect()}
    assert read.value == len(rows) and len(got) == 12 and all(math.isfinite(v) for v in got.values())
    pages = {}
    for _, _, u, v in rows:
        pages.setdefault(u, []).append(v)
    known = lambda p: [v for v in p if v is not None]
    views = {"mean": {u: [np.mean(known(p))] for u, p in pages.items()}, "last": {u: [p[-1]] for u, p in pages.items() if p[-1] is not None}, "flat": {u: [v or 0.0 for v in p] + [0.0] * (600 - len(p)) for u, p in pages.items()}}
    for view, x in views.items():
        a, b = ([u for u in x if (u % 5 == 0) == held] for held in (False, True))
        xa, xb, ya, yb = np.array([x[u] for u in a]), np.array([x[u] for u in b]), np.array([max(known(pages[u])) for u in a]), np.array([max(known(pages[u])) for u in b])
        w = np.linalg.solve((xa - xa.mean(0)).T @ (xa - xa.mean(0)) + np.eye(xa.shape[1]), (xa - xa.mean(0)).T @ (ya - ya.mean()))
        assert got[view, "ridge"] == pytest.approx(np.sqrt(np.mean((ya.mean() + (xb - xa.mean(0)) @ w - yb) ** 2)))


def test_a_vector_of_features_is_its_columns(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(300, 3)))], "i int, a double, b double, c double")
    df = df.withColumns({"y": F.col("a") * 2 - F.col("b"), "v": array_to_vector(F.array("a", "b", "c"))}).repartition(2, "i").cache()
    train, test = df.filter("i % 3 <> 0"), df.filter("i % 3 = 0")
    for kind in ("elasticnet", "boosting"):
        one, many = (learn.fit_predict(train, test, f, "y", kind).select("i", "prediction").sort("i").collect() for f in (["v"], ["a", "b", "c"]))
        assert len(one) == 100 and np.allclose(one, many)
    few = learn.weighted(df.select("v", "y").crossJoin(spark.range(20)), ["v"], "y")
    assert few.count() == 300 and few.agg(F.min("__w")).first()[0] == 20
    x = df.withColumn("w", F.array("a", "b", F.when(F.col("i") > 0, F.col("c")))).select("i", "w", "a", "b", "c", learn.linear_of("w", np.array([1.0, -2.0, 0.5]), 3.0).alias("p")).sort("i").collect()
    assert x[0]["p"] is None and np.allclose([r["p"] for r in x[1:]], [3 + r["a"] - 2 * r["b"] + 0.5 * r["c"] for r in x[1:]])
