"""Smoothing and resampling of one series, a grouped function per key; a series must fit a task's memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..spec import SeriesSpec


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation: weighted harmonic slopes inside, shape-preserving three-point slopes at the ends; NaN outside."""
    if len(x) < 2:
        return np.where(at == x[0], y[0], np.nan) if len(x) else np.full(len(at), np.nan)
    h = np.diff(x)
    s = np.diff(y) / h
    if len(x) == 2:
        d = np.array([s[0], s[0]])
    else:
        u, v = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = s[:-1] * s[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(same, (u + v) / (u / s[:-1] + v / s[1:]), 0.0)

        def end(h0: float, h1: float, s0: float, s1: float) -> float:
            slope = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            if slope * s0 <= 0:
                return 0.0
            return 3 * s0 if s0 * s1 <= 0 and abs(slope) > 3 * abs(s0) else slope

        d = np.r_[end(h[0], h[1], s[0], s[1]), inner, end(h[-1], h[-2], s[-1], s[-2])]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    out = y[k] * (1 + 2 * t) * (1 - t) ** 2 + d[k] * h[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + d[k + 1] * h[k] * t * t * (t - 1)
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def resample_pchip(df: DataFrame, s: SeriesSpec, ts: str, value: str, seconds: float) -> DataFrame:
    """Per key a uniform grid from the first to the last time; repeated times keep the first row, null values are left out."""
    order, keys = list(s.order), list(s.keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(order).drop_duplicates(ts)
        x = (pdf[ts] - pdf[ts].min()).dt.total_seconds().to_numpy()
        at = np.arange(0, x[-1] + 1e-9, seconds) if len(x) else np.empty(0)
        out = pd.DataFrame({"step": np.arange(len(at)), value: pchip(x, pdf[value].to_numpy(float), at)})
        return out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "step", value]]

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, step long, {value} double")


def spectral_mask(y: np.ndarray, share: float) -> np.ndarray:
    """Frequencies whose power is below this share of the largest are set to zero; the mean stays."""
    f = np.fft.rfft(y - y.mean())
    power = np.abs(f) ** 2
    return np.fft.irfft(np.where(power >= share * power.max(), f, 0), len(y)) + y.mean()


def butterworth_gain(y: np.ndarray, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero phase: the squared Butterworth magnitude between two frequencies (cycles a step; low 0 is a low-pass, which keeps the mean), applied to the spectrum."""
    freq = np.fft.rfftfreq(len(y))
    gain = 1 / (1 + (freq / high) ** (2 * order))
    if low > 0:
        with np.errstate(divide="ignore"):
            gain = gain / (1 + np.where(freq > 0, low / freq, np.inf) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y))


def filtered(df: DataFrame, s: SeriesSpec, value: str, f) -> DataFrame:
    """The rows with `value` passed through f series by series."""
    order = list(s.order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(**{value: f(pdf[value].to_numpy(float))})

    return df.groupBy(*s.keys).applyInPandas(run, df.schema)


def recursive(y: np.ndarray, coef: np.ndarray, steps: int) -> np.ndarray:
    """Each forecast (coef on the last values, the newest last) goes back into the window."""
    held = list(y[-len(coef) :])
    for _ in range(steps):
        held.append(float(np.dot(coef, held[-len(coef) :])))
    return np.array(held[-steps:])
