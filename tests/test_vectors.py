"""Pairs of a query set and all rows, in blocks, against plain loops."""

import functools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import vectors as V
from tessella.plans import evaluation_queries, learning_queries, registry, relational_queries  # noqa: F401


def _rows(n=90):
    x = np.random.default_rng(3).normal(size=(n, 5)).astype(np.float32)
    x[60:75] = x[4]  # copies: ties by id
    return x


@pytest.fixture(scope="module")
def held(spark):
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(_rows())]
    return spark.createDataFrame([*rows, (200, None, 1), (None, [0.0] * 5, 2), (201, [1.0, None, 1.0, 1.0, 1.0], 0), (202, [float("nan")] * 5, 0)], "vec_id long, embedding array<float>, label int")


def test_nearest_of_a_query_set_with_ties_and_without_unknown_vectors(held):
    x = _rows().astype(float)
    got = {}
    for r in V.knn(held.filter("vec_id % 4 = 0"), held, 6, keep=("label",)).collect():
        assert r["i_label"] == (r["i"] % 3) and r["j_label"] == r["j"] % 3
        got.setdefault(r["i"], []).append((r["rank"], r["j"], r["d"]))
    assert set(got) == set(range(0, 90, 4))
    for i, found in got.items():
        want = sorted((math.sqrt(functools.reduce(lambda s, v: s + v * v, x[i] - x[j], 0.0)), j) for j in range(90) if j != i)[:6]  # sum() would compensate
        assert [(k + 1, j, d) for k, (d, j) in enumerate(want)] == sorted(found)
    assert V.knn(held.limit(0), held, 2).count() == 0 and V.knn(held, held.limit(0), 2).count() == 0


def test_pairs_in_many_blocks(spark, held):
    x = _rows().astype(float)

    def count(q, r):
        return q.select([]).append_column("n", [[len(r)] * len(q)])

    assert V.blockwise(held.filter("vec_id < 50"), held, count, "n long", block=7, part=10).agg(F.sum("n")).first()[0] == 50 * 93
    got = {(r["i"], r["j"]): r["x"] for r in V.pairs(held.filter("vec_id % 10 = 0"), held, V.dots).collect()}
    assert len(got) == 10 * 92  # nine vectors and 200, which is unknown
    for (i, j), v in got.items():
        if i == 200 or j in (200, 201):
            assert v is None
        elif j != 202:
            s = 0.0
            for a, b in zip(x[i], x[j], strict=True):
                s += a * b
            assert v == s


@pytest.mark.parametrize("name", ["pairwise_distance_stats", "kde_entropy", "spearman_pairdist", "product_distance", "pairwise_self_join"])
def test_sums_over_pairs_are_sqls_with_copies(spark, tmp_path, name):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(230, 64)).astype(np.float32)
    x[150:200] = x[100]
    spark.createDataFrame([(i, r.tolist(), i % 7) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    said = lambda df: sorted(tuple(round(float(v), 6) for v in r) for r in df[sorted(df.columns)].values.tolist())
    got, want = said(registry.QUERIES[name](spark, str(tmp_path)).toPandas()), said(con.execute(registry.ORACLE[name]).df())
    assert len(got) == len(want) and np.allclose(got, want, atol=2e-5)


@pytest.mark.parametrize("name", ["intrinsic_dim_mle", "intrinsic_dim_twonn", "knn_distance_std"])
def test_neighbours_of_all_vectors_are_sqls_with_copies_and_clusters(spark, tmp_path, monkeypatch, name):
    from tessella.operators import graph

    monkeypatch.setattr(graph, "CELL", 20)  # so few that an index would be used
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(20, 64)) * 2, 30, axis=0) + rng.normal(size=(600, 64)) * np.repeat(np.where(np.arange(64) < 6, 1, 0.01)[None], 600, axis=0)).astype(np.float32)
    x[500:540], x[540:570] = x[7], x[10:40]
    spark.createDataFrame([(i, r.tolist(), i % 7) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE[name]).df()
    assert np.allclose(got.values.astype(float), want.values.astype(float), atol=2e-5)


def _every_pair(tmp_path, spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(620, 64)).astype(np.float32) * rng.uniform(0.1, 1, size=(620, 1)).astype(np.float32)  # the hundredth is unlike the rest
    x[600:] = x[5]
    y = rng.integers(0, 7, 620)
    spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return np.sqrt(((x.astype(float)[:, None] - x) ** 2).sum(2)), y


def test_entropy_at_every_vector(spark, tmp_path):
    d, _ = _every_pair(tmp_path, spark)
    want = -np.mean(np.log(np.exp(-d * d / 2).mean(1)) - 32 * np.log(2 * np.pi))
    assert abs(registry.QUERIES["kde_entropy"](spark, str(tmp_path)).first()[0] - want) < 1e-4


def test_distances_of_every_pair(spark, tmp_path):
    d, _ = _every_pair(tmp_path, spark)
    d = d[~np.eye(620, dtype=bool)]
    assert np.allclose(registry.QUERIES["pairwise_distance_stats"](spark, str(tmp_path)).first(), (d.mean(), d.std(ddof=1)), atol=1e-5)


def test_rank_correlation_of_every_pair(spark, tmp_path):
    d, y = _every_pair(tmp_path, spark)
    other = ~np.eye(620, dtype=bool)

    def ranks(v):
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - n + (n + 1) / 2)[at]

    want = np.corrcoef(ranks(d[other].round(6)), ranks(np.abs(y[:, None] - y)[other]))[0, 1]
    assert abs(registry.QUERIES["spearman_pairdist"](spark, str(tmp_path)).first()[0] - want) < 1e-5


@pytest.mark.parametrize("scale", [1, 1e6])  # by place, and sorted
def test_tallies(scale):
    rng = np.random.default_rng(1)
    d, t = np.floor(rng.normal(size=5000) * 100) * scale, rng.normal(size=5000)
    v, n, s = evaluation_queries._tallied(d, np.ones(5000), t)
    assert (v == np.unique(d)).all() and (n == [(d == k).sum() for k in v]).all() and np.allclose(s, [t[d == k].sum() for k in v])


def test_dimension_of_copies_alone_is_unknown(spark, tmp_path):
    spark.createDataFrame([(i, [1.0] * 64, 0) for i in range(30)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert registry.QUERIES["intrinsic_dim_mle"](spark, str(tmp_path)).first()[0] is con.execute(registry.ORACLE["intrinsic_dim_mle"]).fetchone()[0] is None
