"""Twenty-two descriptors of a window's values, after the published feature set of Lubba et al. (2019), written from its
definitions; values are standardised first (sample deviation).

Nine of them are aggregates: windows are laid out as rows, neighbours come from one sorted pass over a window's rows,
and one aggregation makes counts, runs and moments. The other thirteen rest on a window's autocorrelation, spectrum
or fluctuations and are small functions of arrays whose last axis is the window, a batch of windows at a time.

Windows that hold a null, an infinite or only equal values have no descriptors (null); series shorter than a window
have no window. A window is one row of the result and must fit a task's memory, a series needn't.
"""

from __future__ import annotations

from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..spec import SeriesSpec

AGGREGATED = ("histogram_mode_5", "histogram_mode_10", "histogram_information_2", "time_reversal", "big_steps", "longest_above_mean", "longest_fall", "motif_entropy", "mean3_error")
FITTED = (
    "acf_below_1e", "acf_first_minimum", "transition_covariance", "periodicity", "embedding_distance", "gaussian_information_minimum", "residual_memory", "high_outlier_timing", "low_outlier_timing",
    "low_frequency_power", "spectral_centroid", "range_fluctuation_split", "detrended_fluctuation_split",
)
NAMES = AGGREGATED + FITTED


def windows(df: DataFrame, spec: SeriesSpec, value: str, size: int, stride: int) -> DataFrame:
    """Rows of the whole windows: keys, win (from 0), i (place in the window), x. A row goes to each of the size / stride windows that hold it."""
    rows = spec.numbered(df, "__rn").withColumn("__n", spec.length())
    first = F.greatest(F.lit(0), F.ceil((F.col("__rn") - size + 1) / stride))
    last = F.least(F.floor(F.col("__rn") / stride), F.floor((F.col("__n") - size) / stride))
    wins = F.when(first <= last, F.sequence(first, last))
    out = rows.filter(F.col("__n") >= size).select(*spec.keys, F.explode(wins).alias("win"), "__rn", F.col(value).cast("double").alias("x"))
    return out.select(*spec.keys, "win", (F.col("__rn") - F.col("win") * stride).cast("int").alias("i"), "x")


def _entropy(counts: Column, n: Column) -> Column:
    """Sum of -p ln p."""
    return F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / n * F.log(c / n)).otherwise(0.0))


def _counts(value: Column, n: int) -> Column:
    return F.array(*[F.count_if(value == k) for k in range(n)])


def _mode(counts: Column, low: Column, width: Column) -> Column:
    """Mean centre of the fullest bins."""
    full = F.filter(F.transform(counts, lambda c, k: F.when(c == F.array_max(counts), low + (k + 0.5) * width)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(full, F.lit(0.0), lambda s, x: s + x), F.size(full))


def describe(df: DataFrame, spec: SeriesSpec, value: str, size: int, stride: int) -> DataFrame:
    """keys, win and the 22 descriptors of each window."""
    keys = [*spec.keys, "win"]
    run = Window.partitionBy(*keys).orderBy("i")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # summed by place: equal windows have equal z, to the last bit
    rows = windows(df, spec, value, size, stride)
    # a window with a null, an infinity or no spread has no z at all
    ok = (F.count("x").over(whole) == size) & ~F.max(F.isnan("x") | (F.abs("x") == float("inf"))).over(whole) & (F.max("x").over(whole) > F.min("x").over(whole))
    z = F.when(ok, (F.col("x") - F.avg("x").over(whole)) / F.stddev_samp("x").over(whole))
    rows = rows.select(*keys, "i", z.alias("z"))
    third = lambda k: F.percentile("z", F.lit(k / 3.0)).over(whole)
    rows = rows.withColumns({"low": F.min("z").over(whole), "high": F.max("z").over(whole), "q1": third(1), "q2": third(2)})
    bin_ = lambda k, pad: F.least(F.floor((F.col("z") - (F.col("low") - pad)) / ((F.col("high") - F.col("low") + 2 * pad) / k)), F.lit(k - 1)).cast("int")
    letter = F.when(F.col("z") > F.col("q2"), 2).when(F.col("z") > F.col("q1"), 1).otherwise(0)
    rows = rows.withColumns({"b5": bin_(5, 0.0), "b10": bin_(10, 0.0), "e5": bin_(5, 0.1), "letter": letter})
    since = lambda hit: F.col("i") - F.coalesce(F.max(F.when(hit, F.col("i"))).over(run), F.lit(-1))  # noqa: E731  rows since the last hit
    step = F.col("z") - F.lag("z").over(run)
    rows = rows.withColumns(
        {
            "step": step,
            "before": F.lag("e5", 2).over(run),
            "pair": F.lag("letter").over(run) * 3 + F.col("letter"),
            "off": F.when(F.col("i") >= 3, F.col("z") - F.avg("z").over(run.rowsBetween(-3, -1))),
            "above": since(F.col("z") <= 0),
        }
    ).withColumn("falls", since(F.col("step").isNull() | (F.col("step") >= 0)))
    n2 = F.lit(float(size - 2))
    got = rows.groupBy(*keys).agg(
        F.count("z").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        _counts(F.col("b5"), 5).alias("c5"), _counts(F.col("b10"), 10).alias("c10"), _counts(F.col("pair"), 9).alias("motifs"),
        _counts(F.col("before") * 5 + F.col("e5"), 25).alias("joint"), _counts(F.when(F.col("before").isNotNull(), F.col("e5")), 5).alias("second"), _counts(F.col("before"), 5).alias("first"),
        F.avg(F.pow("step", F.lit(3.0))).alias("time_reversal"), F.avg((F.abs("step") * 1000 > 40).cast("double")).alias("big_steps"),
        F.max("above").cast("double").alias("longest_above_mean"), F.max("falls").cast("double").alias("longest_fall"), F.stddev_samp("off").alias("mean3_error"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda s: s["z"]).alias("z"),
    )
    spread = F.col("high") - F.col("low")
    some = F.col("n") == size
    found = got.withColumns(
        {
            "histogram_mode_5": _mode(F.col("c5"), F.col("low"), spread / 5), "histogram_mode_10": _mode(F.col("c10"), F.col("low"), spread / 10),
            "histogram_information_2": _entropy(F.col("first"), n2) + _entropy(F.col("second"), n2) - _entropy(F.col("joint"), n2),
            "motif_entropy": _entropy(F.col("motifs"), F.lit(float(size - 1))), "fitted": _fitted(F.when(some, F.col("z"))),
        }
    )
    return found.select(*keys, *[F.when(some, F.col(c)).alias(c) for c in AGGREGATED], *[F.col("fitted")[c].alias(c) for c in FITTED])


# Of arrays whose last axis is a window's places


def _first(hit: np.ndarray, otherwise: float) -> np.ndarray:
    """Place of the first hit."""
    return np.where(hit.any(-1), hit.argmax(-1), otherwise)


def acf(z: np.ndarray) -> np.ndarray:
    f = np.fft.rfft(z - z.mean(-1, keepdims=True), 2 << (z.shape[-1] - 1).bit_length())
    a = np.fft.irfft(np.abs(f) ** 2)[..., : z.shape[-1]]
    return np.divide(a, a[..., :1], out=np.zeros(a.shape), where=a[..., :1] > 0)


def first_zero(a: np.ndarray) -> np.ndarray:
    """First lag whose autocorrelation isn't positive; the length if there is none."""
    return _first(a[..., 1:] <= 0, a.shape[-1] - 1) + 1


def first_minimum(a: np.ndarray) -> np.ndarray:
    return _first((a[..., 1:-1] < a[..., :-2]) & (a[..., 1:-1] < a[..., 2:]), a.shape[-1] - 1) + 1


def below_1e(a: np.ndarray) -> np.ndarray:
    """Where the autocorrelation falls below 1 / e, between lags."""
    hit = a < 1 / np.e
    k = np.maximum(hit.argmax(-1), 1)[..., None]
    above, under = (np.take_along_axis(a, j, -1)[..., 0] for j in (k - 1, k))
    part = np.divide(above - 1 / np.e, above - under, out=np.zeros(above.shape), where=above != under)
    return np.where(hit.any(-1), k[..., 0] - 1 + part, float(a.shape[-1]))


def _by(values: np.ndarray):
    """Each value with the places that hold it."""
    return ((int(v), np.flatnonzero(values == v)) for v in np.unique(values))


def transition_covariance(z: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Of every tau-th value as one of three equally likely letters: trace of the covariance of the transition matrix's columns."""
    out = np.zeros(len(z))
    for step, at in _by(tau):
        y = z[at, ::step]
        if y.shape[1] < 3:
            continue
        q = np.quantile(y, [1 / 3, 2 / 3], axis=1)[..., None]
        letter = (y > q[0]).astype(int) + (y > q[1])
        pair = letter[:, :-1] * 3 + letter[:, 1:] + 9 * np.arange(len(at))[:, None]
        t = np.bincount(pair.ravel(), minlength=9 * len(at)).reshape(-1, 3, 3) / (y.shape[1] - 1)
        out[at] = t.var(axis=1, ddof=1).sum(-1)
    return out


def periodicity(z: np.ndarray) -> np.ndarray:
    """Lag of the first autocorrelation peak, of the values less a cubic spline of two pieces, that is positive and 0.01 above the trough before it; 0 if there is none."""
    n = z.shape[-1]
    t = np.linspace(-1, 1, n)
    basis = np.stack([np.ones_like(t), t, t**2, t**3, np.maximum(t, 0) ** 3], 1)
    y = z - np.linalg.lstsq(basis, z.T, rcond=None)[0].T @ basis.T
    a = acf(y)[:, : -(-n // 3) + 1]
    out, trough = np.zeros(len(z)), np.full(len(z), np.nan)
    for k in range(1, a.shape[1] - 1):
        before, here, behind = a[:, k - 1], a[:, k], a[:, k + 1]
        trough = np.where((here < before) & (here < behind), here, trough)
        peak = (here > before) & (here > behind) & (here - trough >= 0.01) & (here > 0)
        out = np.where((out == 0) & peak, k, out)
    return np.where(np.abs(y).max(-1) < 1e-9, 0.0, out)


def embedding_distance(z: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Of successive distances in the embedding (x(t), x(t + tau)): mean difference of their histogram from the exponential law of the same mean."""
    out = np.zeros(len(z))
    s = np.diff(z)
    for step, at in _by(np.clip(tau, 1, max(1, z.shape[1] // 10))):
        d = np.hypot(s[at, : s.shape[1] - step], s[at, step:])
        n = d.shape[1]
        mean, width, low, high = d.mean(1), 3.5 * d.std(axis=1, ddof=1) / n ** (1 / 3), d.min(1), d.max(1)
        bins = np.where((mean > 0) & (width > 0), np.maximum(1, np.ceil((high - low) / np.where(width > 0, width, 1))), 0)
        for k, own in _by(bins):
            if not k:
                continue
            x, flat = d[own], low[own] == high[own]
            edges = np.linspace(low[own] - 0.5 * flat, high[own] + 0.5 * flat, k + 1, axis=1)
            place = (x[:, :, None] >= edges[:, None, 1:-1]).sum(-1) + k * np.arange(len(own))[:, None]
            counts = np.bincount(place.ravel(), minlength=k * len(own)).reshape(-1, k)
            centre, m = (edges[:, :-1] + edges[:, 1:]) / 2, mean[own, None]
            out[at[own]] = np.abs(counts / n - np.exp(-centre / m) / m).mean(1)
    return out


def gaussian_information_minimum(z: np.ndarray) -> np.ndarray:
    """First minimum over the lags 1 to 40 (half the length at most) of the information between values a lag apart, as if normal."""
    most = min(40, -(-z.shape[-1] // 2))
    r = np.zeros((len(z), most))
    for k in range(1, most + 1):
        a, b = z[:, :-k], z[:, k:]
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        size = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        r[:, k - 1] = np.divide((a * b).sum(1), size, out=np.zeros(len(z)), where=size > 0)
    info = -0.5 * np.log(np.maximum(1 - np.clip(r, -1, 1) ** 2, 1e-12))
    return _first((info[:, 1:-1] < info[:, :-2]) & (info[:, 1:-1] < info[:, 2:]), most - 2) + 2


def outlier_timing(z: np.ndarray) -> np.ndarray:
    """Over thresholds rising by 0.01, while over 2 % of the values reach them: the median of the reaching values' median place, from -1 (start) to 1 (end)."""
    n = z.shape[-1]
    order = np.argsort(-z, axis=-1, kind="stable")
    down = np.take_along_axis(z, order, -1)
    # thresholds that the k highest values reach, and from them those that exactly k reach
    last = np.floor(down / 0.01)
    last += (last + 1) * 0.01 <= down
    last -= last * 0.01 > down
    upto = np.clip(last + 1, 0, np.maximum(np.ceil(down[:, :1] / 0.01), 0))
    times = upto - np.hstack([upto[:, 1:], np.zeros((len(z), 1))])
    k = np.arange(1, n + 1)
    times[:, (k * 100 / n <= 2) | (k < 2)] = 0
    most = int(np.flatnonzero(times.any(0)).max(initial=-1)) + 1
    if not most:
        return np.zeros(len(z))
    times = times[:, :most]
    median = np.stack([np.median(order[:, :j] + 1, axis=1) for j in range(1, most + 1)], 1) / (n / 2) - 1
    rank = np.argsort(median, axis=1, kind="stable")
    median, run = np.take_along_axis(median, rank, 1), np.cumsum(np.take_along_axis(times, rank, 1), 1)
    total = run[:, -1:]
    low, high = (np.take_along_axis(median, (run > np.floor(half / 2)).argmax(1)[:, None], 1)[:, 0] for half in (total - 1, total))
    return np.where((total[:, 0] > 0) & (down[:, 0] >= 0.01), (low + high) / 2, 0.0)


def spectrum(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Power in the lowest fifth of the frequencies, and the angular frequency below which half of it lies: a rectangular window over all values."""
    n = z.shape[-1]
    size = 1 << (n - 1).bit_length()
    p = np.abs(np.fft.rfft(z, size)) ** 2 / n
    p[:, 1:-1] *= 2
    p, dw = p / (2 * pi), 2 * pi / size
    run = np.cumsum(p, axis=1)
    return p[:, : p.shape[1] // 5].sum(1) * dw, _first(run > run[:, -1:] / 2, 0) * dw


def fluctuation_split(z: np.ndarray, lag: int, by_range: bool) -> np.ndarray:
    """Of the log fluctuation against log scale, the share of scales before the best break into two lines; 0 under twelve scales."""
    length = z.shape[-1]
    scales = np.unique(np.round(np.exp(np.linspace(log(5), log(max(5, length // 2)), 50))).astype(int))
    if len(scales) < 12:
        return np.zeros(z.shape[:-1])
    walk = np.cumsum(z[..., ::lag], -1)
    scales = scales[scales <= walk.shape[-1]]
    if len(scales) < 12:
        return np.zeros(z.shape[:-1])
    size = []
    for s in scales:
        parts = walk[..., : walk.shape[-1] // s * s].reshape(*walk.shape[:-1], -1, s)
        t = np.arange(s) - (s - 1) / 2
        rest = parts - parts.mean(-1, keepdims=True) - (parts @ t / (t @ t))[..., None] * t
        size.append(np.sqrt(np.mean(np.ptp(rest, axis=-1) ** 2, axis=-1)) if by_range else np.sqrt(np.mean(rest**2, axis=(-2, -1))))
    x, y = np.log(scales), np.log(np.maximum(np.stack(size, -1), 1e-12))
    least, n = 6, len(x)

    def misses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Norm of what a line leaves of the first k points, by k."""
        k = np.arange(1, n + 1)
        sx, sy, sxx, sxy, syy = (np.cumsum(v, -1) for v in (x, y, x * x, x * y, y * y))
        vx, vxy, vy = sxx - sx**2 / k, sxy - sx * sy / k, syy - sy**2 / k
        return np.sqrt(np.maximum(vy - np.divide(vxy**2, vx, out=np.zeros(y.shape), where=vx > 0), 0))

    x, y = x - x.mean(), y - y.mean(-1, keepdims=True)
    fore, back = misses(x, y), misses(x[::-1], y[..., ::-1])
    errors = np.stack([fore[..., k - 1] + back[..., n - k] for k in range(least, n - least + 1)], -1)  # the break belongs to both lines
    return (errors.argmin(-1) + least) / n


def fitted(z: np.ndarray) -> tuple[np.ndarray, ...]:
    """The descriptors FITTED of standardised windows, one a row."""
    a = acf(z)
    tau = first_zero(a)
    low, centroid = spectrum(z)
    return (
        below_1e(a), first_minimum(a), transition_covariance(z, tau), periodicity(z), embedding_distance(z, tau), gaussian_information_minimum(z), first_zero(acf(np.diff(z))) / tau,
        outlier_timing(z), outlier_timing(-z), low, centroid, fluctuation_split(z, 1, True), fluctuation_split(z, 2, False),
    )


@F.arrow_udf(StructType([StructField(c, DoubleType()) for c in FITTED]))
def _fitted(windows: pa.Array) -> pa.Array:
    known = np.asarray(windows.is_valid())
    out = np.full((len(FITTED), len(windows)), np.nan)
    if known.any():
        out[:, known] = fitted(np.asarray(windows.drop_null().flatten()).reshape(known.sum(), -1))
    return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=~known) for v in out], list(FITTED))
