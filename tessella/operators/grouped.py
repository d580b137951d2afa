"""Sequential algorithms of one series: a grouped Arrow-backed function per key. A series must fit a task's memory; keys are dealt over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SeriesSpec


def lttb_indices(y: np.ndarray, n: int) -> np.ndarray:
    """Largest triangle, three buckets: first and last rows and the farthest of each bucket between."""
    if n >= len(y) or n < 3:
        return np.arange(len(y))
    x, edges, kept = np.arange(len(y), dtype=float), np.linspace(1, len(y) - 1, n - 1).astype(int), [0]
    for k in range(n - 2):
        a, b = edges[k], max(edges[k] + 1, edges[k + 1])
        after = slice(b, max(b + 1, edges[k + 2])) if k + 2 < len(edges) else slice(len(y) - 1, len(y))
        px, py, cx, cy = x[kept[-1]], y[kept[-1]], x[after].mean(), y[after].mean()
        area = np.abs((x[a:b] - px) * (cy - py) - (cx - px) * (y[a:b] - py))
        kept.append(a + int(area.argmax()))
    return np.array([*kept, len(y) - 1])


def rdp_indices(y: np.ndarray, epsilon: float) -> np.ndarray:
    """Ramer-Douglas-Peucker over positions, with a stack of open spans."""
    keep, spans = np.zeros(len(y), bool), [(0, len(y) - 1)]
    keep[[0, -1]] = True
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        i = np.arange(a + 1, b)
        run, rise = b - a, y[b] - y[a]
        off = np.abs(rise * (i - a) - run * (y[a + 1 : b] - y[a])) / np.hypot(run, rise)
        far = int(off.argmax())
        if off[far] > epsilon:
            keep[i[far]] = True
            spans += [(a, int(i[far])), (int(i[far]), b)]
    return np.flatnonzero(keep)


def _thin(df: DataFrame, s: SeriesSpec, value: str, pick) -> DataFrame:
    order = list(s.order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.iloc[pick(pdf[value].to_numpy(float))]

    return df.groupBy(*s.keys).applyInPandas(run, df.schema)


def lttb(df: DataFrame, s: SeriesSpec, value: str, n: int) -> DataFrame:
    return _thin(df, s, value, lambda y: lttb_indices(y, n))


def rdp(df: DataFrame, s: SeriesSpec, value: str, epsilon: float) -> DataFrame:
    return _thin(df, s, value, lambda y: rdp_indices(y, epsilon))


def welch_of(y: np.ndarray) -> tuple[float, float]:
    """Period of the peak of Welch's density (Hann, half overlap, mean removed, segments of half the series) and the peak over the mean."""
    n = max(2, len(y) // 2)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = [np.abs(np.fft.rfft((seg - seg.mean()) * win)) ** 2 for a in range(0, len(y) - n + 1, max(1, n // 2)) for seg in [y[a : a + n]]]
    p = np.mean(parts, axis=0)
    k = int(p[1:].argmax()) + 1 if len(p) > 1 else 0
    return (n / k if k else float("nan")), float(p[k] / p.mean()) if p.mean() else 0.0


def welch(df: DataFrame, s: SeriesSpec, value: str, fallback: int = 16) -> DataFrame:
    """Per key: period rounded up to a power of two if the peak stands out, else the fallback."""
    order, keys = list(s.order), list(s.keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        period, ratio = welch_of(pdf.sort_values(order)[value].to_numpy(float))
        found = int(2 ** np.ceil(np.log2(period))) if ratio > 2 and period == period else fallback
        return pd.DataFrame([[*key, found, round(ratio, 6)]], columns=[*keys, "period", "ratio"])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, period long, ratio double")


def dtw_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Root of the least sum of squared differences over warping paths."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0 if n == m else float("inf")
    # cell (i, j) of anti-diagonal i + j is held at i; a diagonal needs the two before it, so a step is one vector operation
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    before[0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        new = np.full(n + 1, np.inf)
        new[i] = (a[i - 1] - b[d - i - 1]) ** 2 + np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
        before, last = last, new
    return float(np.sqrt(last[n]))


def dtw_next(df: DataFrame, s: SeriesSpec, value: str) -> DataFrame:
    """Distance of each series (one integer key) to that of the next key."""
    key = s.keys[0]
    arrays = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*s.order, value))), lambda x: x[value]).alias("x"))
    both = arrays.select((F.col(key) - 1).alias(key), F.col("x").alias("y")).join(arrays, key)
    distance = F.pandas_udf(lambda x, y: pd.Series([dtw_distance(np.asarray(a), np.asarray(b)) for a, b in zip(x, y, strict=True)], dtype=float), "double")
    return both.select(key, F.round(distance("x", "y"), 6).alias("dtw"))
