"""Neighbour-based information by brute force and on known distributions."""

import numpy as np
import pytest

from tessella.operators import information as I

GAMMA = 0.5772156649015329


def _psi(m):
    return -GAMMA + sum(1 / j for j in range(1, int(m)))


@pytest.mark.parametrize("across", [4, 64, 10_000])
def test_radii_and_counts_by_brute_force(spark, across):
    rng = np.random.default_rng(0)
    n = 500
    x, y = rng.normal(size=n), rng.exponential(size=n)
    x[:60], y[:30] = 1.0, 2.0
    x[-1] = 40.0  # a far row visits every stripe
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id string, v double, w double")
    d = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, 2]
    found = I.radii(df, 3, n, across).cache()
    got = {int(r["id"]): r["r"] for r in found.collect()}
    assert len(got) == n and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in range(n))
    counts = {int(r["id"]): (r["nv"], r["nw"]) for r in I.within(found, n).collect()}
    near = lambda z, i: max(0, int((abs(z - z[i]) < want[i]).sum()) - 1)
    assert all(counts[i] == (near(x, i), near(y, i)) for i in range(n))


@pytest.mark.parametrize("rho", [0.0, 0.6, 0.95])
def test_known_information_of_normal_columns(spark, rho):
    rng = np.random.default_rng(1)
    n = 4000
    a = rng.normal(size=n)
    b = rho * a + np.sqrt(1 - rho**2) * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))], "i long, a double, b double")
    assert abs(I.mutual_information(df, "a", "b", ["i"]) - -0.5 * np.log(1 - rho**2)) < 0.05  # the stated error at 4,000 rows


def test_the_whole_estimate_by_brute_force(spark):
    rng = np.random.default_rng(2)
    n, k = 300, 3
    a = rng.normal(size=n)
    b = a**2 + 0.3 * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))], "i long, a double, b double")
    x, y = a / a.std(), b / b.std()
    dx, dy = abs(x[:, None] - x), abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, k - 1]
    want = _psi(n) + _psi(k) - np.mean([_psi((dx[i] < r[i]).sum()) + _psi((dy[i] < r[i]).sum()) for i in range(n)])
    assert I.mutual_information(df, "a", "b", ["i"], k) == pytest.approx(want, abs=0.01)
    assert I.mutual_information(df.repartition(7), "a", "b", ["i"], k, across=9) == I.mutual_information(df, "a", "b", ["i"], k)


def test_ties_nulls_and_selection(spark):
    rng = np.random.default_rng(3)
    n = 1500
    c = rng.integers(0, 4, n)
    rows = [(i, float(c[i]), float(3 * c[i] + rng.normal()), float(rng.integers(0, 2)), 5.0) for i in range(n)] + [(n, None, 1.0, 1.0, 5.0), (n + 1, float("nan"), 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "i long, c double, y double, coin double, same double")
    kept = I.mutual_information_select(df, ["coin", "c", "same"], "y", ["i"], 67)
    assert [k for k, _ in kept] == ["c", "coin"] and kept[0][1] > 0.9 and kept[1][1] < 0.05
    assert I.mutual_information(df.limit(3), "c", "y", ["i"]) == 0.0 and I.mutual_information(df.limit(0), "c", "y", ["i"]) == 0.0


def test_digamma(spark):
    from pyspark.sql import functions as F

    got = [r["d"] for r in spark.range(1, 60).select(I.digamma(F.col("id")).alias("d")).collect()]
    assert np.allclose(got, [_psi(m) for m in range(1, 60)], atol=1e-9)


@pytest.mark.parametrize("values", [2, 9, 50, 3000])
def test_nearest_rows_where_values_repeat(values):
    rng = np.random.default_rng(values)
    v, w = rng.normal(size=4000), np.sort(rng.integers(0, values, 4000) / 3 + 1e-10 * rng.normal(size=4000))
    v[:3] += 1e3  # far from their run: other runs are nearer
    w[-1] = 5000.0  # alone
    got = I.nearest_of_all(v, w, 3)
    d = np.maximum(np.abs(v[:, None] - v), np.abs(w[:, None] - w))
    np.fill_diagonal(d, np.inf)
    assert (got == np.sort(d, axis=1)[:, :3]).all()


def test_a_long_run_is_not_walked_row_by_row(monkeypatch):
    rng = np.random.default_rng(0)
    looked = []
    plain = I.nearest_in
    monkeypatch.setattr(I, "nearest_in", lambda *a: looked.append(len(a[2])) or plain(*a))
    I.nearest_of_all(rng.uniform(size=20_000), np.sort(rng.integers(0, 9, 20_000) + 1e-10 * rng.normal(size=20_000)), 3)
    assert sum(looked) < 100


def test_rows_that_stay_in_their_range_are_counted_by_place(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 1200
    z, r = np.round(rng.normal(size=n), 2), rng.exponential(0.05, size=n)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(z, r))], "id long, v double, r double")
    monkeypatch.setattr(I, "RANGE", 100)
    held = []
    plain = I.settled
    monkeypatch.setattr(I, "settled", lambda f, tag: held.append(plain(f, tag)) or held[-1])
    got = {x["id"]: x["n"] for x in I.counted(df, "v", n).collect()}
    assert got == {i: max(0, int((abs(z - z[i]) < r[i] * (1 - 1e-9)).sum()) - 1) for i in range(n)}
    ends = held[0].filter("abs(sign) = 1").count()
    assert 0 < ends < n  # before: two for every row
