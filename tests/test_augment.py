"""Augmentations on small panels: what they keep, what they draw, and that partitioning changes nothing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import augment as A
from tessella.spec import SeriesSpec

S = SeriesSpec(("key",), ("t",))


@pytest.fixture(scope="module")
def rows(spark):
    out = [(k, t, float(10 * k + t), float(t * t) if t % 7 else None) for k in range(30) for t in range(20 + k)] + [(99, 0, 5.0, 6.0)]
    return spark.createDataFrame(out, "key long, t long, a double, b double")


def got(p):
    out = {}
    for r in p.df.collect() if isinstance(p, A.Panel) else p.collect():
        out.setdefault(r["key"], {})[(r["view"], r["pos"]) if "view" in r.asDict() else r["pos"]] = r
    return out


@pytest.mark.parametrize(
    "f",
    [lambda p: A.jitter(p, 0.1, 1), lambda p: A.scaling(p, 0.1, 1), lambda p: A.magnitude_warp(p, 0.1, 1, 3), lambda p: A.time_warp(p, 0.1, 1), lambda p: A.time_warp(p, 0.4, 1, 3),
     lambda p: A.permutation(p, 1), lambda p: A.cropping(p, 0.2, 1), lambda p: A.cropping(p, 0.2, 1, True), lambda p: A.masking(p, 0.2, 1), lambda p: A.drift(p, 0.2, 1)],
)
def test_shape_and_repeatability(spark, rows, f):
    one, two = (got(f(A.panel(df, S, ("a", "b")))) for df in (rows, rows.repartition(7, "t").orderBy(F.desc("a"))))
    assert one == two
    assert {k: sorted(v) for k, v in one.items()} == {**{k: list(range(20 + k)) for k in range(30)}, 99: [0]}
    assert f(A.panel(rows.limit(0), S, ("a", "b"))).df.count() == 0


def test_noise_has_its_moments(spark):
    df = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("t"), F.lit(0.0).alias("a"))
    x = np.array([r["a"] for r in A.jitter(A.panel(df, S, ("a",)), 2.0, 5).df.select("a").collect()])
    assert abs(x.mean()) < 4 * 2 / math.sqrt(len(x)) and abs(x.std() - 2) < 0.05 and abs((x**4).mean() / 16 - 3) < 0.3


def test_what_each_one_keeps(rows):
    p = A.panel(rows, S, ("a", "b"))
    base = got(p)
    scaled, warped, cut, moved, masked = (got(f) for f in (A.scaling(p, 0.1, 2), A.magnitude_warp(p, 0.1, 2), A.cropping(p, 0.25, 2), A.permutation(p, 2), A.masking(p, 0.3, 2)))
    hit = 0
    for k, series in base.items():
        n = len(series)
        for c in ("a", "b"):
            for other in (scaled, warped):
                factors = {round(other[k][i][c] / series[i][c], 9) for i in range(n) if series[i][c]}
                assert len(factors) <= 1 and (other is scaled or all(0.9 <= f <= 1.1 for f in factors))
            assert all((scaled[k][i][c] is None) == (series[i][c] is None) for i in range(n))
        keep = math.floor(n * 0.75)
        start = next(s for s in range(n - keep + 1) if all(cut[k][i]["a"] == series[s + i]["a"] for i in range(keep)))
        assert all(cut[k][i]["a"] == 0.0 and cut[k][i]["b"] == 0.0 for i in range(keep, n)) and 0 <= start
        assert sorted(r["a"] for r in moved[k].values()) == sorted(r["a"] for r in series.values())
        jumps = sum(moved[k][i + 1]["a"] != moved[k][i]["a"] + 1 for i in range(n - 1))
        assert jumps <= 3
        assert all(masked[k][i]["a"] in (0.0, series[i]["a"]) for i in range(n))
        hit += sum(masked[k][i]["a"] == 0.0 for i in range(n))
    total = sum(map(len, base.values()))
    assert abs(hit / total - 0.3) < 4 * math.sqrt(0.21 / total)


def test_curves_are_smooth_and_differ_by_channel(spark):
    df = spark.range(200).select(F.lit(1).alias("key"), F.col("id").alias("t"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    out = got(A.magnitude_warp(A.panel(df, S, ("a", "b")), 0.2, 3, 4))[1]
    a, b = (np.array([out[i][c] for i in range(200)]) for c in ("a", "b"))
    assert abs(a - b).max() > 0.05 and abs(np.diff(a, 2)).max() < 0.01 and a.std() > 0.02


def test_smooth_clock_never_goes_back_and_keeps_its_ends(spark):
    df = spark.range(150).select(F.lit(1).alias("key"), F.col("id").alias("t"), F.col("id").cast("double").alias("a"))
    out = got(A.time_warp(A.panel(df, S, ("a",)), 0.5, 4, 3))[1]
    a = np.array([out[i]["a"] for i in range(150)])
    assert a[0] == 0 and abs(a[-1] - 149) < 1e-9 and (np.diff(a) > 0).all() and abs(a - np.arange(150)).max() > 2


def test_resampling_by_literal_values(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 2, None), (1, 3, 30.0)], "key long, t long, a double")
    p = A.panel(df, S, ("a",))
    out = got(A.resample(p, F.get(F.array(*[F.lit(x) for x in (0.25, 1.0, 1.5, 99.0)]), F.col("pos").cast("int"))))[1]
    assert [out[i]["a"] for i in range(4)] == [2.5, 10.0, None, 30.0]


def test_two_views_always_differ_in_kind(rows):
    out = got(A.two_views(A.panel(rows, S, ("a", "b")), 0.1, 6))
    kinds = set()
    for k, view in out.items():
        n = 1 if k == 99 else 20 + k
        assert sorted(view) == [(v, i) for v in (1, 2) for i in range(n)]
        a, b = ({view[v, i]["kind"] for i in range(n)} for v in (1, 2))
        assert len(a) == len(b) == 1 and a != b
        kinds |= a | b
        assert n == 1 or [view[1, i]["a"] for i in range(n)] != [view[2, i]["a"] for i in range(n)]
    assert kinds == set(A.KINDS)
