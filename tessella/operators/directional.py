"""Directions: von Mises-Fisher samples, concentrations and divergences.

Samples come by rejection (Wood): the cosine with the mean direction is proposed from a beta law and accepted or drawn
again, then a uniform tangent direction is added. A row's draws come from a generator keyed by the seed and its id, so
they are the same on any partitioning, however often it is rejected. Bessel ratios are continued fractions, logarithms of
Bessel functions sums of their series' logarithms: neither overflows at large concentrations.

A null id draws as the word null; a null or zero direction, or a concentration that is null or not positive, gives
null; directions need two dimensions at least.
"""

from __future__ import annotations

from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .vectors import dot


def bessel_ratio(width: int, kappa: float) -> float:
    """I_{d/2}(k) / I_{d/2 - 1}(k): the mean cosine of a sample with the mean direction."""
    if kappa <= 0:
        return 0.0
    # Perron's continued fraction from its tail
    v, out = width / 2 - 1, 0.0
    for n in range(int(2 * kappa) + 60, 0, -1):
        out = 1.0 / (2 * (v + n) / kappa + out)
    return out


def log_bessel(order: float, x: float) -> float:
    """log I_order(x) for x > 0."""
    k = np.arange(int(x + 10 * np.sqrt(x + 1)) + 60)
    terms = (2 * k + order) * log(x / 2) - np.array([lgamma(n + 1) + lgamma(n + order + 1) for n in k])
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum()))


def log_constant(width: int, kappa: float) -> float:
    """Logarithm of the density's factor; at 0 that of the even law on the sphere."""
    if kappa <= 0:
        return lgamma(width / 2) - log(2) - width / 2 * log(pi)
    return (width / 2 - 1) * log(kappa) - width / 2 * log(2 * pi) - log_bessel(width / 2 - 1, kappa)


def divergence(width: int, kappa: float, other: float, cosine: float) -> float:
    """Kullback-Leibler divergence of a law from another (concentrations, and the cosine of their mean directions; other = 0: the even law)."""
    return log_constant(width, kappa) - log_constant(width, other) + bessel_ratio(width, kappa) * (kappa - other * cosine)


def concentration(width: int, length: float) -> float:
    """The concentration whose mean resultant length this is: the usual estimate, then Newton's steps."""
    if not 0 < length < 1:
        return 0.0 if length <= 0 else float("inf")
    kappa = length * (width - length**2) / (1 - length**2)
    for _ in range(5):
        a = bessel_ratio(width, kappa)
        kappa = max(kappa - (a - length) / max(1 - a * a - (width - 1) / kappa * a, 1e-12), 1e-9)
    return kappa


def one(mean: np.ndarray, kappa: float, rng: np.random.Generator) -> np.ndarray:
    """A sample about a unit vector."""
    m = len(mean) - 1
    b = m / (2 * kappa + np.sqrt(4 * kappa * kappa + m * m))
    x = (1 - b) / (1 + b)
    c = kappa * x + m * np.log(1 - x * x)
    while True:
        z = rng.beta(m / 2, m / 2)
        w = (1 - (1 + b) * z) / (1 - (1 - b) * z)
        if kappa * w + m * np.log(1 - x * w) - c >= np.log(1 - rng.random()):
            break
    v = rng.normal(size=m + 1)
    v -= (v @ mean) * mean
    return w * mean + np.sqrt(max(0.0, 1 - w * w)) * v / np.linalg.norm(v)


@F.arrow_udf(ArrayType(DoubleType()))
def _sampled(means: pa.Array, kappas: pa.Array, keys: pa.Array) -> pa.Array:
    out = []
    for mean, kappa, key in zip(means, kappas.to_pylist(), keys.to_pylist(), strict=True):
        if not mean.is_valid or kappa is None or not kappa > 0:
            out.append(None)
            continue
        v = np.asarray(mean.values, float)
        size = np.linalg.norm(v)
        out.append(one(v / size, kappa, np.random.Generator(np.random.Philox(key=key & (1 << 64) - 1))) if size > 0 and np.isfinite(size) else None)
    return pa.array(out, pa.list_(pa.float64()))


def sample(mean: Column, kappa: Column, id_: Column, seed: int = 0) -> Column:
    """A direction about a row's mean direction (any length), with its concentration."""
    known = F.when(F.forall(mean, lambda x: x.isNotNull()), F.transform(mean, lambda x: x.cast("double")))
    return _sampled(known, kappa.cast("double"), F.xxhash64(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("null"))))


def resultants(vector: str, width: int) -> list[Column]:
    """Aggregates: n, and the mean unit vector's entries m0, m1, ...; zero and null vectors don't count."""
    v = F.col(vector)
    size = F.sqrt(dot(v, v))
    unit = lambda k: F.when(size > 0, v[k].cast("double") / size)
    return [F.count(F.when(size > 0, 1)).alias("n"), *[F.avg(unit(k)).alias(f"m{k}") for k in range(width)]]
