"""Kernel principal components from landmarks, and covariance matrices in the tangent space of their geometric mean.

Kernel components (Nystroem): the kernel among at most `LANDMARKS` hashed rows is decomposed in the driver; every row is
then projected where it is, from its kernels with the landmarks, which go with the function. With all rows as landmarks
this is kernel PCA itself; the error at fewer is measured in the tests.

Tangent space: a window's channels have one covariance matrix, an aggregate. Its geometric mean under the affine
invariant metric is the fixed point of averaging logarithms: a round is one pass, in which a task adds up the
logarithms of its matrices and a d x d sum comes to the driver. Vectors are the upper triangle of a matrix's logarithm
at the mean, off-diagonal entries times the root of two. A small multiple of the identity keeps matrices of few or
dependent rows positive. Windows with a null channel value in every row have no matrix and are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .augment import draw

LANDMARKS = 512


def _rows(v: pa.Array) -> np.ndarray:
    return np.asarray(v.flatten(), float).reshape(len(v), -1)


def _lists(x: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows of x as lists, null where not known; x has the known rows only."""
    ends = np.concatenate([[0], np.cumsum(known * x.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~known, False)), pa.array(x.ravel()))


def kernel_components(df: DataFrame, id_: str, vector: str, width: int, gamma: float, landmarks: int = LANDMARKS, seed: int = 0) -> tuple[Column, np.ndarray]:
    """A column function: the leading kernel principal components (Gaussian kernel) of a row's vector, null for a null vector; and the eigenvalues."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    known = df.filter(F.col(vector).isNotNull() & F.col(id_).isNotNull())
    chosen = known.select(F.col(id_).alias("i"), v.alias("v")).orderBy(draw(seed, "landmark", F.col(id_)), "i").limit(landmarks).collect()
    if not chosen:
        return F.lit(None).cast("array<double>"), np.zeros(0)
    z = np.array([r["v"] for r in chosen])

    def kernel(x: np.ndarray) -> np.ndarray:
        return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (z**2).sum(1) - 2 * x @ z.T, 0))

    k = kernel(z)
    mean = k.mean(0)
    values, vectors = np.linalg.eigh(k - mean - mean[:, None] + k.mean())
    order = np.argsort(-values)[: min(width, int((values > 1e-10 * values[-1]).sum()))]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    back, whole = vectors / np.sqrt(values[order]), k.mean()

    @F.arrow_udf(ArrayType(DoubleType()))
    def project(rows: pa.Array) -> pa.Array:
        held = np.asarray(rows.is_valid())
        x = _rows(rows.drop_null()) if held.any() else np.zeros((0, z.shape[1]))
        own = kernel(x)
        return _lists((own - own.mean(1, keepdims=True) - mean + whole) @ back, held)

    return project(v), values[order]


def covariances(df: DataFrame, keys: list[str], channels: list[str], eps: float = 1e-6) -> DataFrame:
    """keys, m: the channels' sample covariance matrix (row by row) plus eps on the diagonal; one row counts as spread 0."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    rows = df.filter(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in channels))
    got = rows.groupBy(*keys).agg(*[F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(f"__{a}_{b}") for a, b in pairs])
    cell = lambda a, b: F.col(f"__{a}_{b}" if (a, b) in pairs else f"__{b}_{a}") + F.lit(eps if a == b else 0.0)
    return got.select(*keys, F.array(*[cell(a, b) for a in channels for b in channels]).alias("m"))


def _function(m: np.ndarray, f) -> np.ndarray:
    """f of the eigenvalues of symmetric matrices."""
    values, vectors = np.linalg.eigh(m)
    return (vectors * f(np.maximum(values, 1e-300))[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def logarithms(m: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Of matrices, at a mean."""
    back = _function(mean, lambda v: v**-0.5)
    return _function(back @ m @ back, np.log)


def geometric_mean(df: DataFrame, matrix: str, width: int, rounds: int = 50, close: float = 1e-9) -> np.ndarray:
    """The fixed point; rounds end when a step's Frobenius norm is below close. An empty table has the identity."""
    first = df.agg(*[F.avg(F.col(matrix)[k]).alias(f"c{k}") for k in range(width * width)]).first()
    if first["c0"] is None:
        return np.eye(width)
    mean = np.array([first[f"c{k}"] for k in range(width * width)]).reshape(width, width)
    kind = pa.schema([("s", pa.list_(pa.float64())), ("n", pa.int64()), ("b", pa.float64())])
    for _ in range(rounds):

        def added(batches, mean=mean):
            total, n, bend = np.zeros((width, width)), 0, 0.0
            for b in batches:
                if b.num_rows:
                    logs = logarithms(_rows(b.column(0)).reshape(-1, width, width), mean)
                    total += logs.sum(0)
                    n += b.num_rows
                    spread = np.ptp(np.linalg.eigvalsh(logs), axis=1)  # the logarithm of the condition number
                    bend += float(np.where(spread > 1e-6, spread / 2 / np.tanh(np.maximum(spread, 1e-6) / 2), 1.0).sum())
            yield pa.RecordBatch.from_pydict({"s": [total.ravel().tolist()], "n": [n], "b": [bend]}, kind)

        sums = [F.sum(F.col("s")[k]).alias(f"c{k}") for k in range(width * width)]
        got = df.select(matrix).mapInArrow(added, "s array<double>, n long, b double").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), *sums).first()
        step = np.array([got[f"c{k}"] for k in range(width * width)]).reshape(width, width) / got["n"]
        root = _function(mean, np.sqrt)
        mean = root @ _function_exp(step * 2 / (1 + got["b"] / got["n"])) @ root  # the wider the matrices, the shorter the step
        mean = (mean + mean.T) / 2
        if np.linalg.norm(step) < close:
            break
    return mean


def _function_exp(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return (vectors * np.exp(values)) @ vectors.T


def tangent(matrix: str, mean: np.ndarray) -> Column:
    """A matrix as a vector of d (d + 1) / 2 numbers in the tangent space at the mean."""
    d = len(mean)
    upper = np.triu_indices(d)
    weight = np.where(upper[0] == upper[1], 1.0, np.sqrt(2))

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(rows: pa.Array) -> pa.Array:
        held = np.asarray(rows.is_valid())
        m = _rows(rows.drop_null()).reshape(-1, d, d) if held.any() else np.zeros((0, d, d))
        return _lists(logarithms(m, mean)[:, upper[0], upper[1]] * weight, held)

    return run(F.col(matrix))
