"""Shapley values of tree ensembles, by dynamic programming along every path to a leaf.

A feature outside a coalition follows both branches in proportion to the training rows behind them (the path-dependent
value). A leaf then counts for a coalition with the product of its features' factors: whether the row passes all of a
feature's splits on the path (in the coalition) or the share of training rows that do (outside). The polynomial whose
coefficients sum these products by coalition size is made once a leaf, and each feature is divided out of it again,
so a leaf with d features costs d squared steps and no coalition is listed. Leaves are a model's, not the data's, and
go with the function; rows are valued a batch at a time where they are.

Rows with a null feature have no values (null), as the models leave them out.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@dataclass(frozen=True)
class Leaf:
    """A path: for each feature on it the interval (above, most] and the share of training rows that stay within; value: what the leaf adds."""

    value: float
    features: tuple[int, ...]
    above: tuple[float, ...]
    most: tuple[float, ...]
    share: tuple[float, ...]


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted tree, forest or boosted ensemble of Spark ML with continuous splits."""
    trees = getattr(model, "trees", None)
    weights = list(getattr(model, "treeWeights", [1.0])) if trees else [1.0]
    mean = sum(weights) if trees and "Forest" in type(model).__name__ else 1.0
    out: list[Leaf] = []

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.numDescendants() == 0:
            kept = sorted(path.items())
            columns = list(zip(*(p for _, p in kept), strict=True)) or [(), (), ()]
            out.append(Leaf(weight * node.prediction(), tuple(f for f, _ in kept), *columns))
            return
        split, rows = node.split(), float(node.impurityStats().count())
        f, at = int(split.featureIndex()), float(split.threshold())
        above, most, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, span in ((node.leftChild(), (above, min(most, at))), (node.rightChild(), (max(above, at), most))):
            walk(child, weight, path | {f: (*span, share * float(child.impurityStats().count()) / rows)})

    for tree, w in zip(trees or [model], weights, strict=True):
        walk(tree._call_java("rootNode"), w / mean, {})
    return out


def base(found: list[Leaf]) -> float:
    """The value of the empty coalition."""
    return float(sum(x.value * np.prod(x.share) for x in found))


def values(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """Shapley values of rows x features."""
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        passes = ((own > np.array(leaf.above)) & (own <= np.array(leaf.most))).astype(float)
        poly = np.zeros((len(x), d + 1))
        poly[:, 0] = 1.0
        for k in range(d):
            poly[:, 1:] = poly[:, 1:] * leaf.share[k] + poly[:, :-1] * passes[:, k : k + 1]
            poly[:, 0] *= leaf.share[k]
        weights = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
        for k, f in enumerate(leaf.features):
            hit = passes[:, k] > 0
            # without the feature: divided by (share + t) where it passes, by its share elsewhere
            quotient, total = np.zeros(len(x)), np.zeros(len(x))
            for s in range(d - 1, -1, -1):
                quotient = np.where(hit, poly[:, s + 1] - leaf.share[k] * quotient, poly[:, s] / leaf.share[k])
                total += weights[s] * quotient
            out[:, f] += leaf.value * (passes[:, k] - leaf.share[k]) * total
    return out


def attributed(found: list[Leaf], features: list[str]) -> Column:
    """Array of the features' Shapley values for a row."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(rows: pa.Array) -> pa.Array:
        width = len(features)
        known = rows.is_valid()
        flat = rows.filter(known)
        x = np.asarray(flat.flatten()).reshape(len(flat), width) if len(flat) else np.zeros((0, width))
        got = values(x, found)
        ends = np.concatenate([[0], np.cumsum(np.asarray(known.cast(pa.int32())) * width)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~np.asarray(known), False)), pa.array(got.ravel()))

    known = ~sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in features).cast("boolean")
    return run(F.when(known, F.array(*[F.col(c).cast("double") for c in features])))


def fit_boosted(train: DataFrame, features: list[str], target: str, rounds: int = 100, depth: int = 4, rate: float = 0.1, seed: int = 42):
    from .learn import fit_boosting

    return fit_boosting(train, features, target, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)


def mean_absolute(test: DataFrame, models: list, features: list[str]) -> DataFrame:
    """feature, mean_abs_shap: over all rows and models (targets); one pass, one row a feature."""
    found = [leaves(m) for m in models]
    rows = test.select(*[attributed(x, features).alias(f"m{k}") for k, x in enumerate(found)])
    sums = rows.agg(*[F.avg(sum(F.abs(F.col(f"m{k}")[i]) for k in range(len(found))) / len(found)).alias(f"f{i}") for i in range(len(features))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("mean_abs_shap")) for i, c in enumerate(features)])).alias("s")).select("s.*")


def shap_select(train: DataFrame, test: DataFrame, features: list[str], targets: list[str], **settings) -> DataFrame:
    """Features whose mean importance over the targets' boosted models is at least the median are kept, the models fitted anew on them, and valued on test: feature, mean_abs_shap."""
    fit = lambda names: [fit_boosted(train, names, y, **settings) for y in targets]
    weight = np.mean([m.featureImportances.toArray() for m in fit(features)], axis=0)
    kept = [c for c, w in zip(features, weight, strict=True) if w >= np.median(weight)]
    return mean_absolute(test, fit(kept), kept)
