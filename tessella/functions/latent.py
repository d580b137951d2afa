"""Column functions on latent vectors, schedules and cluster weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.vectors import dot, l2


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def kl_to_normal(mu: Column, logvar: Column) -> Column:
    """Divergence of a diagonal Gaussian's dimension from N(0, 1)."""
    return 0.5 * (mu * mu + F.exp(logvar) - logvar - 1.0)


def decay_linear(step: Column, steps: int, first: float, last: float) -> Column:
    return F.lit(first) + (last - first) * F.least(F.lit(1.0), step / float(steps))


def decay_cosine(step: Column, steps: int, first: float, last: float) -> Column:
    return F.lit(last) + 0.5 * (first - last) * (1.0 + F.cos(F.pi() * F.least(F.lit(1.0), step / float(steps))))


def distances_to(vec: Column, centres: list[list[float]]) -> Column:
    """Array of L2 distances to centres that are part of the plan (their number is a model's, not the input's)."""
    return F.array(*[l2(vec, F.array(*[F.lit(float(x)) for x in c])) for c in centres])


def softmax(values: Column) -> Column:
    high = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp(v - high))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.transform(weights, lambda w: w / total)


def nearest(distances: Column) -> Column:
    """Index of the least, the first of equals."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
