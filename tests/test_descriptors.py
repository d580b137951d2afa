"""Descriptors on literal series and by plain loops."""

import math

import numpy as np
import pytest

from tessella.operators import descriptors as D
from tessella.spec import SeriesSpec

S = SeriesSpec(("key",), ("t",))
N = 64


def _series():
    rng = np.random.default_rng(0)
    t = np.arange(N)
    walk = np.cumsum(rng.normal(size=N))
    return {"noise": rng.normal(size=N), "wave": np.sin(2 * np.pi * t / 8), "rise": t.astype(float), "saw": (t % 5).astype(float), "walk": walk, "spikes": np.where(t > 55, 9.0, 0.0) + 0.01 * rng.normal(size=N)}


SERIES = _series()


def _z(x):
    return (x - x.mean()) / x.std(ddof=1)


@pytest.fixture(scope="module")
def described(spark):
    names = sorted(SERIES)
    rows = [(k, t, float(v)) for k, name in enumerate(names) for t, v in enumerate(SERIES[name])]
    rows += [(50, t, 3.0) for t in range(N)] + [(51, t, None if t == 9 else float(t)) for t in range(N)] + [(52, t, float(t)) for t in range(N - 1)] + [(53, t, float("inf") if t == 3 else float(t)) for t in range(N)]
    df = spark.createDataFrame(rows, "key long, t long, value double")
    out = {r["key"]: r for r in D.describe(df, S, "value", N, 16).collect()}
    assert D.describe(df.limit(0), S, "value", N, 16).count() == 0
    assert sorted(out) == [*range(len(names)), 50, 51, 53]
    return {name: out[k] for k, name in enumerate(names)} | {"equal": out[50], "null": out[51], "infinite": out[53]}


def _longest(hits):
    best = run = 0
    for h in hits:
        run = run + 1 if h else 0
        best = max(best, run)
    return best


def _entropy(counts):
    p = np.asarray(counts, float).ravel()
    p = p[p > 0] / p.sum()
    return -(p * np.log(p)).sum()


@pytest.mark.parametrize("name", sorted(SERIES))
def test_aggregates_by_loops(described, name):
    z, got = _z(SERIES[name]), described[name]
    near = lambda c, want: got[c] == pytest.approx(want, abs=1e-6)
    step = np.diff(z)
    assert near("time_reversal", (step**3).mean()) and near("big_steps", (np.abs(step) > 0.04).mean())
    assert near("longest_above_mean", _longest(z > 0)) and near("longest_fall", _longest(step < 0))
    assert near("mean3_error", np.std([z[i] - z[i - 3 : i].mean() for i in range(3, N)], ddof=1))
    if name in ("noise", "walk"):  # elsewhere bins' ends fall on values
        for k in (5, 10):
            counts, edges = np.histogram(z, k)
            assert near(f"histogram_mode_{k}", ((edges[:-1] + edges[1:]) / 2)[counts == counts.max()].mean())
        e = np.minimum(((z - (z.min() - 0.1)) / ((np.ptp(z) + 0.2) / 5)).astype(int), 4)
        joint = np.zeros((5, 5))
        np.add.at(joint, (e[:-2], e[2:]), 1)
        assert near("histogram_information_2", _entropy(joint.sum(0)) + _entropy(joint.sum(1)) - _entropy(joint))
        letter = (z > np.quantile(z, 1 / 3)).astype(int) + (z > np.quantile(z, 2 / 3))
        pairs = np.zeros((3, 3))
        np.add.at(pairs, (letter[:-1], letter[1:]), 1)
        assert near("motif_entropy", _entropy(pairs))


def test_windows_without_descriptors(described):
    for name in ("equal", "null", "infinite"):
        assert all(described[name][c] is None for c in D.NAMES)


def test_fitted_on_literal_series(described):
    wave, rise, spikes = described["wave"], described["rise"], described["spikes"]
    assert wave["acf_first_minimum"] == 4 and wave["periodicity"] == 8 and 1 < wave["acf_below_1e"] < 2
    assert abs(wave["spectral_centroid"] - 2 * math.pi / 8) < 0.1 and wave["low_frequency_power"] < 0.01
    assert wave["gaussian_information_minimum"] == 2  # a quarter of the period has no correlation
    assert rise["residual_memory"] < 1 and 0.85 < rise["low_frequency_power"] < 1 and rise["periodicity"] == 0
    assert spikes["high_outlier_timing"] > 0.8 and spikes["longest_above_mean"] == 8 and abs(rise["high_outlier_timing"] + rise["low_outlier_timing"]) < 0.1
    saw = described["saw"]
    assert saw["periodicity"] == 5 and saw["longest_fall"] == 1


@pytest.mark.parametrize("name", sorted(SERIES))
def test_fitted_by_definitions(described, name):
    z, got = _z(SERIES[name]), described[name]
    a = np.array([(z[: N - k] * z[k:]).sum() for k in range(N)]) / (z * z).sum()
    assert np.allclose(D.acf(z), a)
    k = next(k for k in range(N) if a[k] < 1 / math.e)
    assert k - 1 <= got["acf_below_1e"] <= k
    reach = []
    for th in np.arange(0, z.max(), 0.01):
        at = [i + 1 for i in range(N) if z[i] >= th]
        if len(at) * 100 / N <= 2 or len(at) < 2:
            break
        reach.append(np.median(at) / (N / 2) - 1)
    assert got["high_outlier_timing"] == pytest.approx(np.median(reach))
    tau = next((k for k in range(1, N) if a[k] <= 1e-12), N)
    if name not in ("wave", "saw", "rise"):  # there zeros are met exactly
        y = z[::tau]
        q = np.quantile(y, [1 / 3, 2 / 3])
        letter = [int(v > q[0]) + int(v > q[1]) for v in y]
        t = np.zeros((3, 3))
        for p, r in zip(letter, letter[1:]):
            t[int(p), int(r)] += 1 / (len(y) - 1)
        assert got["transition_covariance"] == pytest.approx(np.trace(np.cov(t.T)))


@pytest.mark.parametrize("by_range,lag", [(True, 1), (False, 2)])
def test_fluctuations_by_plain_fits(by_range, lag):
    for x in SERIES.values():
        z = _z(x)
        scales = sorted({int(round(math.exp(v))) for v in np.linspace(math.log(5), math.log(N // 2), 50)})
        walk = np.cumsum(z[::lag])
        scales = [s for s in scales if s <= len(walk)]
        size = []
        for s in scales:
            rests = [p - np.polyval(np.polyfit(range(s), p, 1), range(s)) for p in (walk[k * s : (k + 1) * s] for k in range(len(walk) // s))]
            size.append(np.sqrt(np.mean([np.ptp(r) ** 2 for r in rests])) if by_range else np.sqrt(np.mean(np.square(rests))))
        lx, ly = np.log(scales), np.log(np.maximum(size, 1e-12))
        miss = lambda a, b: np.linalg.norm(b - np.polyval(np.polyfit(a, b, 1), a))
        errors = {k / len(lx): miss(lx[:k], ly[:k]) + miss(lx[k - 1 :], ly[k - 1 :]) for k in range(6, len(lx) - 5)}
        assert errors[D.fluctuation_split(z, lag, by_range)] == pytest.approx(min(errors.values()), abs=1e-6)


#: On the edge of a histogram's bin by exact arithmetic: 18 + (15328 - 18) / 5 = 3080 hundredths.
EDGED = [30.86, 45.87, 22.84, 39.2, 68.75, 20.2, 72.69, 19.44, 109.96, 27.39, 5.37, 70.37, 97.18, 60.54, 65.78, 35.39, 0.35, 30.8, 20.44, 27.77, 31.47, 25.39, 10.96, 57.56, 21.86, 12.22, 16.49, 92.09, 38.51, 9.69, 80.59, 33.93, 153.28, 42.03, 61.72, 53.74, 45.71, 33.7, 96.54, 28.65, 81.44, 0.18, 32.2, 122.79, 4.06, 17.91, 5.02, 81.09]


def test_equal_windows_are_told_alike_whatever_the_order_of_rows(spark):
    """A mean and deviation summed in another order end in another last bit, which decides the bin of a value on an edge."""
    rng = np.random.default_rng(3)
    rows = [(k, int(t), EDGED[t]) for k in range(60) for t in rng.permutation(48)]
    got = D.describe(spark.createDataFrame(rows, "key long, t long, value double"), S, "value", 48, 12).drop("key").distinct().collect()
    assert len(got) == 1


def test_batches_of_windows_are_told_as_each_alone():
    rng = np.random.default_rng(4)
    for n in (6, 20, 48, 64):
        x = np.concatenate([rng.integers(0, 4, (40, n)), np.cumsum(rng.normal(size=(40, n)), 1), [np.arange(n) % 5]])
        z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
        whole = np.stack(D.fitted(z), 1)
        assert whole.shape == (81, len(D.FITTED)) and np.allclose(whole, [np.stack(D.fitted(r[None]), 1)[0] for r in z])
