"""Queries on attributions of fitted models and on information between columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import directional as D
from ..operators import graph as G
from ..operators import information as I
from ..operators import manifold as K
from ..operators import vectors as V
from ..operators.settle import settled
from ..sources import files as R
from ..sources import zarr as Z
from .evaluation_queries import _parts
from .learning_queries import EV, LINEAR
from .registry import query


@query()
def importance_shap(t):
    """Of the features of at least median importance: mean absolute Shapley value over the test rows, of boosted trees (20 rounds, depth 4)."""
    train, test = _parts(t)
    return A.shap_select(train, test, LINEAR, ["l_extendedprice"], rounds=20)


@query()
def shap_values(t):
    """Every test row's Shapley values; with the base they add up to the prediction."""
    train, test = _parts(t)
    model = A.fit_boosted(train, LINEAR, "l_extendedprice", rounds=10)
    found = A.leaves(model)
    rows = test.withColumn("phi", A.attributed(found, LINEAR)).filter("phi is not null")
    total = F.aggregate("phi", F.lit(A.base(found)), lambda s, x: s + x)
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.col("phi")[i], 4).alias(f"shap_{c}") for i, c in enumerate(LINEAR)], F.round(total, 4).alias("prediction"))


@query()
def mutual_info_neighbours(t):
    """Each feature's information with the price, by three neighbours, over all training rows."""
    rows = _parts(t)[0]
    found = I.mutual_information_select(rows, LINEAR, "l_extendedprice", ["l_orderkey", "l_linenumber"], 100)
    return t.spark.createDataFrame(found, "feature string, information double")


def _of(t):
    """The embeddings' neighbour graph: nodes, members, edges, recall, probes."""
    nodes, members = G.nodes_of(t.embeddings, "vec_id", "embedding")
    return (nodes, members, *G.graph(nodes, 20, F.col("id") % 100 == 0))


@query()
def knn_graph(t):
    """Undirected edges of the graph of 20 neighbours, with its recall measured on the stated query set."""
    _, _, edges, share, _ = _of(t)
    return edges.select("i", "j", F.round("d", 6).alias("d"), F.lit(round(share, 4)).alias("recall"))


@query()
def geodesic_distances(t):
    """Shortest path lengths in the graph from 32 landmarks to every vector."""
    nodes, members, edges, _, _ = _of(t)
    marks = G.landmarks(nodes, 32)
    dist = G.geodesics(nodes, edges, marks)
    pairs = F.array(*[F.struct(F.lit(m).alias("landmark"), F.round(F.col(f"d{k}"), 6).alias("distance")) for k, m in enumerate(marks)])
    return members.join(dist, "id").select(F.col("own").alias("vec_id"), F.explode(pairs).alias("p")).select("vec_id", "p.*")


@query()
def isomap(t):
    """Five coordinates of every vector, from 32 landmarks."""
    nodes, members, edges, _, _ = _of(t)
    marks = G.landmarks(nodes, 32)
    placed, _ = G.landmark_scaling(G.geodesics(nodes, edges, marks), marks, 5)
    return members.join(placed, "id").select(F.col("own").alias("vec_id"), *[F.round(F.get("y", F.lit(k)), 5).alias(f"y{k}") for k in range(5)])


@query()
def isomap_residual_variance(t):
    """For one to ten coordinates."""
    nodes, _, edges, _, _ = _of(t)
    marks = G.landmarks(nodes, 32)
    dist = G.geodesics(nodes, edges, marks)
    placed, _ = G.landmark_scaling(dist, marks, 10)
    return t.spark.createDataFrame([(w, round(x, 5)) for w, x in G.residual_variance(dist, placed, marks, list(range(1, 11)))], "dimension int, residual_variance double")


@query()
def spectral_clustering(t):
    """Five clusters of the graph."""
    _, members, edges, _, _ = _of(t)
    found, _ = G.spectral_clusters(edges, 5)
    return members.join(found, "id").select(F.col("own").alias("vec_id"), "cluster")


@query()
def kernel_pca(t):
    """Eight components of every vector, from 256 landmarks."""
    column, _ = K.kernel_components(t.embeddings, "vec_id", "embedding", 8, 0.05, landmarks=256)
    return t.embeddings.select("vec_id", column.alias("y")).select("vec_id", *[F.round(F.get("y", F.lit(k)), 5).alias(f"y{k}") for k in range(8)])


def _windows(t):
    """Windows of 16 rows of each user's value, its change and its k."""
    rows = EV.numbered(t.events).withColumns({"win": F.floor(F.col("rn") / 16), "k": F.get_json_object("props", "$.k").cast("double")})
    step = F.coalesce(F.col("value") - F.lag("value").over(EV.window()), F.lit(0.0))
    return rows.select("user_id", "win", "value", "k", step.alias("step"))


COV = """SELECT user_id, win::BIGINT AS win, {cells} FROM (SELECT user_id, (row_number() OVER w - 1) // 16 AS win, value, json_extract_string(props, '$.k')::DOUBLE AS k, coalesce(value - lag(value) OVER w, 0) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1, 2"""
CHANNELS = ["value", "step", "k"]


@query(COV.format(cells=", ".join(f"round(coalesce(covar_samp({a}, {b}), 0){' + 1e-6' if a == b else ''}, 8) AS {a}_{b}" for i, a in enumerate(CHANNELS) for b in CHANNELS[i:])))
def window_covariances(t):
    m = K.covariances(_windows(t), ["user_id", "win"], CHANNELS)
    cells = [F.round(F.col("m")[i * 3 + j], 8).alias(f"{a}_{b}") for i, a in enumerate(CHANNELS) for j, b in enumerate(CHANNELS) if i <= j]
    return m.select("user_id", F.col("win").cast("long").alias("win"), *cells)


@query()
def tangent_space(t):
    """Every window's covariance matrix in the tangent space of the geometric mean of all."""
    m = settled(K.covariances(_windows(t), ["user_id", "win"], CHANNELS), "covariances")
    mean = K.geometric_mean(m, "m", 3)
    return m.select("user_id", F.col("win").cast("long").alias("win"), K.tangent("m", mean).alias("v")).select("user_id", "win", *[F.round(F.col("v")[k], 5).alias(f"v{k}") for k in range(6)])


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events), n AS (SELECT max(user_id) // 10 + 1 AS lats FROM events),
g AS (SELECT i, j, k, lats FROM n, range(48) a(i), range((SELECT lats FROM n)) b(j), range(10) c(k))
SELECT TIMESTAMP '1959-01-01' + to_hours((6 * g.i)::INT) AS time, round(CASE WHEN lats > 1 THEN -90 + 180.0::DOUBLE * j / (lats - 1) ELSE -90 END, 6) AS lat, k * 36.0::DOUBLE AS lon, (j * 10 + k)::BIGINT AS cell, value
FROM g LEFT JOIN s ON s.i = g.i AND s.user_id = j * 10 + k WHERE g.i >= 20""")
def scan_zarr_grid(t):
    """The users' first 48 events as a field, a user a cell, written in chunks; read from the sixth day on."""
    path = R.scratch(t.spark, "grid")
    lats = (t.events.agg(F.max("user_id")).first()[0] or 0) // 10 + 1
    rows = EV.numbered(t.events).select(F.col("rn").alias("i"), F.expr("user_id div 10").alias("j"), F.expr("user_id % 10").alias("k"), "value")
    Z.write_grid(rows, path, (48, lats, 10), (8, 16, 10))
    grid = Z.read_grid(t.spark, path).filter(F.col("time") >= F.lit("1959-01-06 00:00:00").cast("timestamp_ntz"))
    return grid.withColumn("lat", F.round("lat", 6))


@query()
def vmf_sample(t):
    """A direction about each embedding's, with a concentration by label, and its cosine with it."""
    kappa = 50.0 * (1 + F.col("label") % 3)
    made = t.embeddings.select("vec_id", "label", "embedding", D.sample(F.col("embedding"), kappa, F.col("vec_id"), 5).alias("s"))
    return made.select("vec_id", "label", F.round(V.dot(F.col("embedding"), F.col("s")) / F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 6).alias("cosine"))


@query()
def vmf_divergence(t):
    """Each label's von Mises-Fisher law, fitted by its mean direction, and its divergence from the law of all vectors."""
    got = t.embeddings.rollup("label").agg(*D.resultants("embedding", 64)).collect()  # a row a label
    laws = {r["label"]: (r["n"], np.array([r[f"m{k}"] for k in range(64)])) for r in got if r["n"]}
    out, (_, all_) = [], laws.get(None, (0, np.ones(64)))
    fit = lambda m: D.concentration(64, float(np.linalg.norm(m)))
    for label, (n, m) in sorted((k, v) for k, v in laws.items() if k is not None):
        cosine = float(m @ all_ / np.linalg.norm(m) / np.linalg.norm(all_))
        out.append((label, n, round(fit(m), 4), round(D.divergence(64, fit(m), fit(all_), cosine), 5)))
    return t.spark.createDataFrame(out, "label int, n long, kappa double, divergence double")
