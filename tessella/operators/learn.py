"""Models from moments: one pass gathers counts, means and covariances (d x d numbers a task), and ridge regression, principal
components and the Fréchet distance are solved from them on the driver. What comes to the driver grows with the width of a
vector, not with the rows.

Rows whose vector is null or holds a null are left out; an empty table has moments of count 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.latent import distances_to, nearest
from .settle import settled

# The penalties tried by the ridge search.
ALPHAS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0)
#: Rows that a forest draws for a tree.
DRAWS = 5000
#: So many rows a distinct row of features, and models are fitted on the distinct rows.
REPEATS = 10


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # population

    @property
    def sample_cov(self) -> np.ndarray:
        return self.cov * self.n / max(1, self.n - 1)


def moments_by(df: DataFrame, vector: Column, group: Column, groups: int) -> list[Moments]:
    """For each group (from 0): of [1, x - shift], sums of products by task, then by position, in one pass. The shift (one row) keeps large means from cancelling."""
    rows = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v"), group.cast("int").alias("g")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    first = rows.first()
    if first is None:
        return [Moments(0, np.zeros(0), np.zeros((0, 0)))] * groups
    shift = np.array(first["v"], float)
    d = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, d + 1, d + 1))
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - shift
            z, g = np.hstack([np.ones((len(x), 1)), x]), b.column("g").to_numpy(zero_copy_only=False)
            for k in range(groups):
                own = z[g == k] if groups > 1 else z
                total[k] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["t"])

    sums = rows.mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"))
    out = []
    for g in np.array([r["x"] for r in sorted(sums.collect())]).reshape(groups, d + 1, d + 1):
        n = g[0, 0]
        m = g[0, 1:] / max(n, 1.0)
        out.append(Moments(int(n), m + shift, g[1:, 1:] / max(n, 1.0) - np.outer(m, m)))
    return out


def moments(df: DataFrame, vector: Column) -> Moments:
    """Of all rows; a vector with a null is left out."""
    return moments_by(df, vector, F.lit(0), 1)[0]


def ridge(m: Moments, alpha: float, targets: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (features by targets) and intercepts; the targets are the last entries of the vector and the intercept isn't penalised."""
    d = len(m.mean) - targets
    coef = np.linalg.solve(m.n * m.cov[:d, :d] + alpha * np.eye(d), m.n * m.cov[:d, d:])
    return coef, m.mean[d:] - m.mean[:d] @ coef


def linear(features: list[str], coef: np.ndarray, intercept: float) -> Column:
    """The prediction as an expression, so scoring stays in the scan's stage."""
    out = F.lit(float(intercept))
    for c, w in zip(features, coef, strict=True):
        out = out + F.col(c) * float(w)
    return out


def linear_of(vector: str, coef: np.ndarray, intercept: float) -> Column:
    """The same of an array's entries, however many; null if one is."""
    weights = F.array(*[F.lit(float(w)) for w in coef])
    return F.aggregate(F.zip_with(F.col(vector), weights, lambda x, w: x * w), F.lit(float(intercept)), lambda s, x: s + x)


def ridge_alpha_search(train: DataFrame, valid: DataFrame, features: list[str], target: str, alphas: tuple[float, ...] = ALPHAS) -> list[tuple[float, float, float]]:
    """(alpha, rmse, mae), best sum of both first: all penalties come from one pass over train and are scored in one over valid."""
    m = moments(train, F.array(*features, target))
    aggs = []
    for k, a in enumerate(alphas):
        coef, intercept = ridge(m, a)
        miss = F.col(target) - linear(features, coef[:, 0], intercept[0])
        aggs += [F.sqrt(F.avg(miss * miss)).alias(f"r{k}"), F.avg(F.abs(miss)).alias(f"m{k}")]
    got = valid.agg(*aggs).first()
    return sorted(((a, got[f"r{k}"], got[f"m{k}"]) for k, a in enumerate(alphas)), key=lambda t: t[1] + t[2])


def components(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions (rows, the largest entry of each positive) and their shares of variance."""
    values, vectors = np.linalg.eigh(m.cov)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return vectors * signs[:, None], values / max(values.sum(), 1e-300)


def components_for(shares: np.ndarray, level: float) -> int:
    """The first count of components that reaches the level."""
    return min(len(shares), int(np.argmax(np.cumsum(shares) >= level - 1e-12)) + 1)


def frechet(a: Moments, b: Moments) -> float:
    """Squared distance of means + tr(A + B - 2 sqrt(AB)); the root's trace comes from the eigenvalues of the symmetric form."""
    values, vectors = np.linalg.eigh(a.sample_cov)
    root = vectors @ np.diag(np.sqrt(np.clip(values, 0, None))) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ b.sample_cov @ root), 0, None)).sum()
    gap = a.mean - b.mean
    return float(gap @ gap + np.trace(a.sample_cov) + np.trace(b.sample_cov) - 2 * cross)


def random_features(vector: Column, width: int, features: int, gamma: float, seed: int = 0) -> list[Column]:
    """Cosine features whose inner products approach exp(-gamma |x - y|^2); kernel means then need one pass, not pairs."""
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(0, np.sqrt(2 * gamma), (features, width)), rng.uniform(0, 2 * np.pi, features)
    scale = float(np.sqrt(2 / features))
    out = []
    for row, b in zip(w, shift, strict=True):
        inner = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in row]), lambda x, y: x.cast("double") * y), F.lit(float(b)), lambda s, x: s + x)
        out.append(scale * F.cos(inner))
    return out


def random_vector(vector: Column, width: int, features: int, gamma: float, seed: int = 0) -> Column:
    """The same features as one array, by a product of matrices a batch; a null vector has none (null)."""
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(0, np.sqrt(2 * gamma), (features, width)), rng.uniform(0, 2 * np.pi, features)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        known = np.asarray(vectors.is_valid())
        x = np.asarray(vectors.drop_null().flatten(), dtype=float).reshape(-1, width)
        ends = np.concatenate([[0], np.cumsum(known * features)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~known, False)), pa.array((np.sqrt(2 / features) * np.cos(x @ w.T + shift)).ravel()))

    return run(vector)


def mmd_rbf(df: DataFrame, vector: Column, width: int, side: Column, gamma: float, features: int = 64, seed: int = 0) -> DataFrame:
    """Squared distance of both samples' kernel means in one aggregate; side is 0 or 1."""
    rows = df.select(side.alias("side"), *[c.alias(f"f{k}") for k, c in enumerate(random_features(vector, width, features, gamma, seed))])
    gap = rows.agg(*[(F.avg(F.when(F.col("side") == 0, F.col(f"f{k}"))) - F.avg(F.when(F.col("side") == 1, F.col(f"f{k}")))).alias(f"g{k}") for k in range(features)])
    return gap.select(sum(F.col(f"g{k}") ** 2 for k in range(features)).alias("mmd"))


def kmeans_centres(df: DataFrame, vector: str, k: int, seed: int = 1) -> list[list[float]]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"))
    return [list(map(float, c)) for c in KMeans(k=k, seed=seed, maxIter=20).fit(rows).clusterCenters()]


def cluster_score(df: DataFrame, vector: str, centres: list[list[float]]) -> dict[str, float]:
    """Calinski-Harabasz and negated Davies-Bouldin from moments by cluster; fewer than two clusters in use give -1."""
    d = distances_to(F.col(vector), centres)
    rows = df.select(F.col(vector).alias("v"), d.alias("d")).select("v", "d", nearest(F.col("d")).alias("c"))
    width = range(len(centres[0]))
    per = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("v")[i].cast("double")).alias(f"m{i}") for i in width], *[F.var_pop(F.col("v")[i].cast("double")).alias(f"s{i}") for i in width])
    got = sorted(per.collect())  # one row a centre
    if len(got) < 2:
        return {"calinski_harabasz": -1.0, "davies_bouldin": -1.0}
    n, mean = np.array([r["n"] for r in got], float), np.array([[r[f"m{i}"] for i in width] for r in got])
    within = np.array([sum(r[f"s{i}"] for i in width) for r in got])
    whole = (n[:, None] * mean).sum(0) / n.sum()
    between, inside, k = (n * ((mean - whole) ** 2).sum(1)).sum(), (n * within).sum(), len(got)
    spread, gap = np.sqrt(within), np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(-1))
    np.fill_diagonal(gap, np.inf)
    worst = ((spread[:, None] + spread[None]) / gap).max(1)
    return {"calinski_harabasz": float(between / (k - 1) / max(inside / max(1.0, n.sum() - k), 1e-300)), "davies_bouldin": -float(worst.mean())}


def kmeans_best_k(df: DataFrame, vector: str, first: int, last: int, seed: int = 1, restarts: int = 5) -> int:
    """The k of the half-open range with the highest Calinski-Harabasz score, as the mean of so many starts."""
    score = lambda k: sum(cluster_score(df, vector, kmeans_centres(df, vector, k, seed + n))["calinski_harabasz"] for n in range(restarts)) / restarts
    return max(range(first, last), key=score)


def is_vector(df: DataFrame, features: list[str]) -> bool:
    """Whether the features are one column of vectors instead of columns of numbers."""
    from pyspark.ml.linalg import VectorUDT

    return len(features) == 1 and isinstance(df.schema[features[0]].dataType, VectorUDT)


def assembled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    if is_vector(df, features):
        return df.filter(F.col(target).isNotNull() & F.col(features[0]).isNotNull()).withColumn("__x", F.col(features[0]))
    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df.filter(F.col(target).isNotNull()))


def repeating(df: DataFrame, features: list[str]) -> bool:
    """Whether rows repeat their features REPEATS times (about, by one pass)."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*features)).alias("d")).first()
    return got["n"] >= REPEATS * max(1, got["d"])


def weighted(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows without nulls and their weight __w. Where they repeat, rows of equal features are one with their mean target and their number as weight:
    squared errors then differ by a constant, so that trees, boosting and descent by them are those of all rows."""
    rows = df.select(*features, target).dropna(subset=[*features, target])
    if not repeating(rows, features):
        return rows.withColumn("__w", F.lit(1.0))
    return settled(rows.groupBy(*features).agg(F.avg(target).alias(target), F.count(F.lit(1)).cast("double").alias("__w")), "weighted")


def fit_boosting(train: DataFrame, features: list[str], target: str, **settings):
    """Spark's boosted trees."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="__x", labelCol=target, weightCol="__w", **settings).fit(assembled(weighted(train, features, target), features, target))


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first: a row goes left where its feature is at most the cut; at a leaf both ways lead to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int32), np.arange(len(x))
        while True:
            new = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            if (new == at).all():
                return self.value[at]
            at = new


def grown(x: np.ndarray, y: np.ndarray, depth: int, least: int, tries: int, rng: np.random.Generator) -> list[list[float]]:
    """A regression tree's columns: at a node the cut, among `tries` features, that leaves the least squares, midway between values, with `least` rows on both sides."""
    columns = [[0], [np.inf], [0], [0], [y.mean()]]
    left = [(0, np.arange(len(y)), 0)]
    while left:
        node, rows, level = left.pop()
        own, best = y[rows] - columns[4][node], (1e-12 * max(1e-300, float(((y[rows] - columns[4][node]) ** 2).sum())), None, None)
        if level == depth or len(rows) < 2 * least:
            continue
        k = np.arange(1, len(rows))
        for f in rng.permutation(x.shape[1])[:tries]:
            order = np.argsort(x[rows, f], kind="stable")
            v, run = x[rows[order], f], np.cumsum(own[order])[:-1]
            gain = np.where((v[1:] > v[:-1]) & (k >= least) & (len(rows) - k >= least), run**2 / k + run**2 / (len(rows) - k), -1.0)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                middle = (v[at] + v[at + 1]) / 2
                best = (gain[at], f, middle if middle < v[at + 1] else v[at])
        if best[1] is None:
            continue
        goes = x[rows, best[1]] <= best[2]
        columns[0][node], columns[1][node] = int(best[1]), float(best[2])
        for side, part in ((2, rows[goes]), (3, rows[~goes])):
            columns[side][node] = new = len(columns[0])
            for column, held in zip(columns, (0, np.inf, new, new, y[part].mean()), strict=True):
                column.append(held)
            left.append((new, part, level + 1))
    return columns


def fit_forest(train: DataFrame, features: list[str], target: str, trees: int = 100, draws: int = DRAWS, most: int = 16, least: int = 2, seed: int = 1) -> list[Tree]:
    """Trees of depth min(most, int(log2 n)) on min(draws, n) expected draws with replacement each. Rows are drawn for all trees in one pass (of independent Poisson counts their sum is one too, its trees evenly chosen), dealt to their trees,
    and each tree grows where its draws are: work beyond that pass is bounded by trees * draws, whatever the rows."""
    rows = train.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y")).filter("y is not null and not isnan(y) and not exists(x, v -> v is null or isnan(v))")
    n = rows.count()
    if not n:
        raise ValueError("no row to learn from")
    mean = trees * min(draws, n) / n
    tries = int(np.ceil(np.sqrt(len(features))))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            times = rng.poisson(mean, b.num_rows)
            at = np.repeat(np.arange(b.num_rows), times)
            yield pa.RecordBatch.from_arrays([pa.array(rng.integers(0, trees, len(at)).astype(np.int32)), *[b.column(c).take(pa.array(at)) for c in ("x", "y")]], ["tree", "x", "y"])

    def grow(t: pa.Table) -> pa.Table:
        x, y = np.asarray(t.column("x").combine_chunks().flatten()).reshape(len(t), -1), t.column("y").to_numpy()
        order = np.lexsort((y, *x.T))  # whatever order the draws came in
        number = t.column("tree")[0].as_py()
        got = grown(x[order], y[order], min(most, int(np.log2(n))), least, tries, np.random.default_rng([seed, trees, number]))
        return pa.table({"tree": pa.array([number], pa.int32()), **{c: pa.array([v], pa.list_(pa.float64())) for c, v in zip(("feature", "cut", "left", "right", "value"), got, strict=True)}})

    found = rows.mapInArrow(drawn, "tree int, x array<double>, y double").groupBy("tree").applyInArrow(grow, "tree int, feature array<double>, cut array<double>, left array<double>, right array<double>, value array<double>")
    whole = lambda v: np.array(v).astype(np.int32)
    return [Tree(whole(r["feature"]), np.array(r["cut"]), whole(r["left"]), whole(r["right"]), np.array(r["value"])) for r in sorted(found.collect(), key=lambda r: r["tree"])]  # the model


def forest_predict(forest: list[Tree], features: list[str]) -> Column:
    """The trees' mean; equal rows of a batch are predicted once."""

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        x = np.asarray(rows.flatten()).reshape(len(rows), len(features))
        own, back = np.unique(x, axis=0, return_inverse=True)
        return pa.array((sum(t.predict(own) for t in forest) / len(forest))[back.ravel()])

    return run(F.array(*[F.col(c).cast("double") for c in features]))


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, kind: str, seed: int = 1) -> DataFrame:
    """test with a column `prediction`; kind: elasticnet, random_forest, boosting, logistic. Rows with a null feature are imputed by the mean (elastic net) or left out; a feature may also be one column of vectors, null or whole.
    The forest is the reference's: 100 trees of depth min(16, int(log2 n)) on min(5000, n) expected draws each, a root of the features at a split, two rows a leaf; above twice as many rows as a tree draws, it grows on the draws alone."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.feature import Imputer
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    if kind == "elasticnet" and not is_vector(train, features):
        filler = Imputer(inputCols=features, outputCols=features, strategy="mean").fit(train)
        train, test = filler.transform(train), filler.transform(test)
    at = {"featuresCol": "__x", "labelCol": target}
    rows = assembled(test, features, target)
    scored = lambda model: model.transform(rows).select(*test.columns, F.col("prediction").cast("double").alias("prediction"))
    if kind == "boosting":
        return scored(fit_boosting(train, features, target, maxIter=20, seed=seed))
    known = assembled(train, features, target)
    if kind == "random_forest" and (n := max(1, known.count())) > 2 * DRAWS:  # Spark ML takes every row through every tree, though it draws few
        seen = test.filter(sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in features) == 0)
        return seen.withColumn("prediction", forest_predict(fit_forest(train, features, target, seed=seed), features))

    models = {
        "random_forest": lambda: RandomForestRegressor(numTrees=100, maxDepth=min(16, int(np.log2(n))), minInstancesPerNode=2, subsamplingRate=min(DRAWS, n) / n, featureSubsetStrategy="sqrt", seed=seed, **at),
        "elasticnet": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5, standardization=False, **at),
        "logistic": lambda: OneVsRest(classifier=LogisticRegression(**at), **at),
    }
    return scored(models[kind]().fit(known))


def mutual_info_select(df: DataFrame, features: list[str], target: str, percent: float, bins: int = 10) -> list[tuple[str, float]]:
    """The features with the highest scores, max(1, percent of all) of them, each scored alone; rows whose features are all zero are left out."""
    rows = df.filter(sum(F.coalesce((F.col(c) != 0).cast("int"), F.lit(0)) for c in features) > 0)
    scores = sorted(((c, mutual_info_binned(rows, c, target, bins)) for c in features), key=lambda s: (-s[1], s[0]))
    return scores[: max(1, int(percent * len(features) / 100))]


def mutual_info_binned(df: DataFrame, feature: str, target: str, bins: int = 10) -> float:
    """Mutual information (nats) between quantile bins of both; the bins' bounds and at most bins x bins counts come to the driver. A different estimator from a neighbour-based one."""
    at = [k / bins for k in range(1, bins)]
    bounds = df.agg(F.percentile_approx(feature, at, 10_000).alias("a"), F.percentile_approx(target, at, 10_000).alias("b")).first()
    place = lambda c, cuts: sum((F.col(c) > x).cast("int") for x in sorted(set(cuts)))
    if bounds["a"] is None or bounds["b"] is None:
        return 0.0
    counts = df.filter(F.col(feature).isNotNull() & F.col(target).isNotNull()).groupBy(place(feature, bounds["a"]).alias("x"), place(target, bounds["b"]).alias("y")).count().collect()
    p = np.zeros((bins, bins))
    for r in counts:
        p[r["x"], r["y"]] = r["count"]
    p /= p.sum()
    free = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log(p[p > 0] / free[p > 0])).sum())


def fit_per_cluster(train: DataFrame, test: DataFrame, features: list[str], target: str, k: int, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """test with columns cluster and prediction: k-means on the training features, a ridge model for each cluster in use. Every test row is predicted by its nearest centre's model."""
    rows = train.filter(sum(F.col(c).isNull().cast("int") for c in [*features, target]) == 0).withColumn("__v", F.array(*[F.col(c).cast("double") for c in features]))
    centres = kmeans_centres(rows, "__v", k, seed)
    place = lambda df: df.withColumn("cluster", nearest(distances_to(F.array(*[F.col(c).cast("double") for c in features]), centres)))
    rows, out = place(rows), F.lit(None).cast("double")
    for c, m in enumerate(moments_by(rows, F.array(*features, target), F.col("cluster"), len(centres))):
        if m.n:
            coef, intercept = ridge(m, alpha)
            out = F.when(F.col("cluster") == c, linear(features, coef[:, 0], intercept[0])).otherwise(out)
    return place(test).withColumn("prediction", out)


def cluster_and_label(train: DataFrame, test: DataFrame, vector: str, target: str, k: int = 10, seed: int = 42) -> DataFrame:
    """test with a prediction: the mean target of the training rows whose nearest k-means centre is its own. The clusters are found without targets."""
    centres = kmeans_centres(train, vector, k, seed)
    place = lambda df: df.withColumn("cluster", nearest(distances_to(F.col(vector), centres)))
    means = place(train).groupBy("cluster").agg(F.avg(target).alias("prediction"))  # at most k rows
    return place(test).join(F.broadcast(means), "cluster", "left")


def bootstrapped(rows: DataFrame, features: list[str], target: str, trees: int, seed: int) -> DataFrame:
    """Distinct rows of features with, for each tree, the number of its draws (w0...) and the sum of their targets (y0...): every row is drawn a Poisson number of times by every tree, in one pass."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            times = rng.poisson(1.0, (trees, b.num_rows)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, times)], [*b.schema.names, *[f"t{k}" for k in range(trees)]])

    kept = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"))
    drawn = kept.mapInArrow(draw, ", ".join([f"{c} double" for c in kept.columns] + [f"t{k} tinyint" for k in range(trees)]))
    sums = [s for k in range(trees) for s in (F.sum(F.col(f"t{k}").cast("double")).alias(f"w{k}"), F.sum(F.col(f"t{k}") * F.col("y")).alias(f"y{k}"))]
    return settled(drawn.groupBy(*[F.col(f"x{i}").alias(c) for i, c in enumerate(features)]).agg(*sums), "draws")


def forest_importances(df: DataFrame, features: list[str], target: str, trees: int, depth: int, seed: int) -> np.ndarray:
    """Of Spark's forest; where rows repeat their features, its trees are fitted one by one on the distinct rows, weighted by their draws."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.regression import RandomForestRegressor

    at = {"featuresCol": "__x", "labelCol": target, "maxDepth": depth}
    rows = df.select(*features, target).filter(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in [*features, target]))
    if not repeating(rows, features):
        return RandomForestRegressor(numTrees=trees, seed=seed, **at).fit(assembled(df, features, target)).featureImportances.toArray()
    drawn = bootstrapped(rows, features, target, trees, seed)

    def one(k: int) -> np.ndarray:
        own = drawn.filter(F.col(f"w{k}") > 0).select(*features, (F.col(f"y{k}") / F.col(f"w{k}")).alias(target), F.col(f"w{k}").alias("__w"))
        tree = RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="auto" if trees == 1 else "onethird", weightCol="__w", seed=seed + k, **at)
        return tree.fit(assembled(own, features, target)).featureImportances.toArray()

    with ThreadPool(min(4, trees)) as pool:
        total = sum(pool.map(inheritable_thread_target(df.sparkSession)(one), range(trees)))
    return total / max(total.sum(), 1e-300)


def importances(df: DataFrame, features: list[str], targets: list[str], trees: int = 20, depth: int = 5, seed: int = 42) -> dict[str, float]:
    """Mean importance of each feature over forests, one a target."""
    total = np.zeros(len(features))
    for y in targets:
        total += forest_importances(df, features, y, trees, depth, seed)
    return dict(zip(features, (total / len(targets)).tolist(), strict=True))


def importance_select(df: DataFrame, features: list[str], targets: list[str], **settings) -> list[tuple[str, float]]:
    """Features whose mean importance is at least the median, most important first."""
    found = importances(df, features, targets, **settings)
    least = float(np.median(list(found.values())))
    return sorted(((c, x) for c, x in found.items() if x >= least), key=lambda s: (-s[1], s[0]))


def rfe(df: DataFrame, features: list[str], target: str, share: float = 0.95, **settings) -> list[tuple[str, float]]:
    """Recursive elimination: the least important feature goes, the rest is fitted anew, until int(features * share) of them (one at least) are left; most important first."""
    left = list(features)
    found = importances(df, left, [target], **settings)
    while len(left) > max(1, int(len(features) * share)):
        left.remove(min(left, key=lambda c: (found[c], c)))
        found = importances(df, left, [target], **settings)
    return sorted(found.items(), key=lambda s: (-s[1], s[0]))


def tune_grid(train: DataFrame, features: list[str], target: str, grid: dict[str, list], folds: int = 3, parallelism: int = 4, seed: int = 42) -> list[tuple]:
    """(parameters in the grid's order..., mean RMSE over the folds), the best first: elastic net over the product of the grid's values."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    model = LinearRegression(featuresCol="__x", labelCol=target)
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(model.getParam(name), values)
    maps = build.build()
    fitted = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"), numFolds=folds, parallelism=parallelism, seed=seed).fit(assembled(train, features, target))
    rows = [(*[float(m[model.getParam(name)]) for name in grid], float(score)) for m, score in zip(maps, fitted.avgMetrics, strict=True)]
    return sorted(rows, key=lambda r: (r[-1], r))


@dataclass(frozen=True)
class Net:
    """A regression net: layers of (weights, biases), the smooth x * sigmoid(x) between them, on standardised features and target."""

    layers: tuple
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Input and pre-activation of each layer."""
        out, held = x, []
        for k, (w, b) in enumerate(self.layers):
            z = out @ w + b
            held.append((out, z))
            out = z / (1 + np.exp(-z)) if k < len(self.layers) - 1 else z
        return held

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.forward((x - self.mean[:-1]) / self.scale[:-1])[-1][1][:, 0]
        return z * self.scale[-1] + self.mean[-1]


def fit_net(train: DataFrame, features: list[str], target: str, hidden: tuple[int, ...] = (16, 16), epochs: int = 20, rate: float = 0.02, decay: float = 0.01, seed: int = 0) -> Net:
    """Full-batch descent with adaptive moments and decoupled decay. Each epoch is one pass: every task sums its rows' gradients, so rows never leave their tasks and the driver holds only the weights. Equal rows of features count once, by their number."""
    m = moments(train, F.array(*features, target))
    scale = np.sqrt(np.clip(np.diag(m.cov), 1e-24, None))
    rng, sizes = np.random.default_rng(seed), [len(features), *hidden, 1]
    layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    rows = weighted(train, features, target).select(F.array(*[F.col(c).cast("double") for c in [*features, target]]).alias("v"), "__w")
    flat = lambda parts: np.concatenate([p.ravel() for pair in parts for p in pair])
    first, second = np.zeros(len(flat(layers))), np.zeros(len(flat(layers)))
    for epoch in range(1, epochs + 1):
        net = Net(tuple(layers), m.mean, scale)

        def run(batches: Iterator[pa.RecordBatch], net: Net = net) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(flat(net.layers)))
            for b in batches:
                x = (b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(net.mean)) - net.mean) / net.scale
                held = net.forward(x[:, :-1])
                back, grads = 2 * (held[-1][1] - x[:, -1:]) * b.column("__w").to_numpy()[:, None], []
                for k in range(len(held) - 1, -1, -1):
                    if k < len(held) - 1:
                        s = 1 / (1 + np.exp(-held[k][1]))
                        back = back * s * (1 + held[k][1] * (1 - s))
                    grads.append((held[k][0].T @ back, back.sum(0)))
                    back = back @ net.layers[k][0].T
                total += flat(grads[::-1])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["t"])

        sums = rows.mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).collect()
        g = np.array([r["x"] for r in sorted(sums)]) / max(1, m.n)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        new, at = flat(layers) * (1 - rate * decay) - step, 0
        for k, (w, b) in enumerate(layers):
            layers[k] = (new[at : at + w.size].reshape(w.shape), new[at + w.size : at + w.size + b.size])
            at += w.size + b.size
    return Net(tuple(layers), m.mean, scale)


def net_predict(df: DataFrame, net: Net, features: list[str]) -> DataFrame:
    """df with a column prediction; a null feature gives null."""
    predict = F.arrow_udf(lambda v: pa.array(net.predict(np.asarray(v.flatten()).reshape(len(v), len(features)))), "double")
    return df.withColumn("prediction", F.nullif(predict(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])), F.lit(float("nan"))))


def kernel_svm(train: DataFrame, test: DataFrame, vector: str, width: int, label: str, penalties: tuple[float, ...] = (0.01, 0.1, 1.0), features: int = 64, folds: int = 3, seed: int = 0) -> DataFrame:
    """test with a prediction (0 or 1): a linear machine on random features of the Gaussian kernel exp(-|x - y|^2 / (width * variance)), the penalty chosen by cross-validation."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    m = moments(train, F.col(vector))
    gamma = 1.0 / max(1e-12, width * float(np.trace(m.cov) / width + m.mean.var()))
    inputs = lambda df: df.withColumn("__x", array_to_vector(random_vector(F.col(vector), width, features, gamma, seed)))
    model = LinearSVC(featuresCol="__x", labelCol=label, maxIter=20)
    grid = ParamGridBuilder().addGrid(model.regParam, list(penalties)).build()
    search = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"), numFolds=folds, parallelism=3, seed=seed)
    known = inputs(train).select("__x", label).persist()
    model = search.fit(known)
    known.unpersist()
    return model.transform(inputs(test)).select(*test.columns, "prediction")
