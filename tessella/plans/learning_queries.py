"""Queries on samples, splits, clusters, pseudo-labels, models, distribution distances, resampling and files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import latent as L
from ..operators import grouped as G
from ..operators import learn as M
from ..operators import sampling as P
from ..operators import series as S
from ..operators import signal as X
from ..operators import vectors as V
from ..sources import files as R
from ..spec import SeriesSpec
from .registry import query

EV = SeriesSpec(("user_id",), ("ts", "event_id"))
RN = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
#: The stated query set of the pair operators, against all vectors.
ASKED = "vec_id % 100 = 0"
UNNEST = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings"
CENTRES = f"WITH p AS ({UNNEST}), c AS (SELECT label AS centre, i, avg(x) AS m FROM p GROUP BY 1, 2), d AS (SELECT vec_id, centre, sqrt(sum((x - m) * (x - m))) AS d FROM p JOIN c USING (i) GROUP BY 1, 2)"
SOFT = CENTRES + ", q AS (SELECT vec_id, centre, d, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS q FROM d)"
PAIRS = f"WITH a AS ({UNNEST}), d AS (SELECT a.vec_id AS i_, b.vec_id AS j_, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM a JOIN a b USING (i) GROUP BY 1, 2)"
LINEAR = ["l_quantity", "l_discount", "l_tax"]


def _centres(t) -> tuple[list, list[list[float]]]:
    """Labels and their mean vectors: one row a class."""
    n = range(64)
    got = t.embeddings.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in n]).orderBy("label").collect()
    return [r["label"] for r in got], [[r[f"m{i}"] for i in n] for r in got]


def _soft(t):
    """vec_id, centre, d, q in long form."""
    labels, centres = _centres(t)
    d = t.embeddings.select("vec_id", "label", L.distances_to(F.col("embedding"), centres).alias("d")).withColumn("q", L.softmax(F.transform("d", lambda x: -x)))
    return d.select("vec_id", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("centre"), "d", "q")).alias("z")).select("vec_id", "z.centre", "z.d", "z.q")


def _vector():
    return F.col("embedding")


# Samples, splits, positions


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id")
def sort_time(t):
    return t.events.select("event_id", "ts").orderBy("ts", "event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def tail_n(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id")


@query("SELECT event_id FROM events QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 5 = 0")
def stride_rows(t):
    return P.positions(t.events.select("event_id"), "event_id")[0].filter("pos % 5 = 0").select("event_id")


@query(f"SELECT event_id FROM (SELECT event_id, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))")
def truncate_to_common_length(t):
    shortest = t.events.groupBy("user_id").count().agg(F.min("count").alias("least"))
    return EV.numbered(t.events).join(F.broadcast(shortest), F.col("rn") < F.col("least")).select("event_id")


@query("SELECT event_id, value FROM events")
def drop_all_null_columns(t):
    df = t.events.select("event_id", "value").withColumn("none", F.lit(None).cast("double"))
    there = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in there.items() if not n])


@query("SELECT event_id, value FROM events")
def drop_constant_targets(t):
    df = t.events.select("event_id", "value").withColumn("flat", F.lit(2.5))
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in ("value", "flat")]).first().asDict()
    return df.drop(*[c for c, s in spread.items() if s == 0])


@query("SELECT event_id, event_type = 'click' AS is_input FROM events WHERE event_type = 'click' OR user_id = (SELECT min(user_id) FROM events)")
def scenario_rules(t):
    """Observed rows are inputs, unobserved rows of the focal track targets; others vanish."""
    focal = t.events.agg(F.min("user_id").alias("focal"))
    rows = t.events.join(F.broadcast(focal), (F.col("event_type") == "click") | (F.col("user_id") == F.col("focal")))
    return rows.select("event_id", (F.col("event_type") == "click").alias("is_input"))


@query(f"SELECT event_id, rn <= floor(n * 0.8) AS train FROM (SELECT event_id, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def holdout(t):
    return EV.numbered(t.events).withColumn("n", EV.length()).select("event_id", (F.col("rn") < F.floor(F.col("n") * 0.8)).alias("train"))


@query(f"SELECT event_id FROM (SELECT event_id, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn > n - greatest(1, ceil(0.2 * (n // 16))) * 16")
def split_by_windows(t):
    held = F.greatest(F.lit(1), F.ceil(0.2 * F.floor(F.col("n") / 16))) * 16
    return EV.numbered(t.events).withColumn("n", EV.length()).filter(F.col("rn") >= F.col("n") - held).select("event_id")


def _share(seed, *columns):
    """The SQL of sampling.share."""
    return f"(('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(columns) + "), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE)"


@query(f"SELECT event_id, user_id, floor({_share(7, 'user_id')} * 5)::INT AS fold FROM events")
def group_kfold(t):
    return t.events.select("event_id", "user_id", F.floor(P.share(7, "user_id") * 5).cast("int").alias("fold"))


@query(f"SELECT user_id, row_number() OVER (ORDER BY {_share(7, 'user_id')}) - 1 < floor(count(*) OVER () * 0.2) AS test FROM (SELECT DISTINCT user_id FROM events)")
def split_random_pages(t):
    """The floor of a fifth of the pages, by hash order, is the test part."""
    pages, n = P.positions(t.events.select("user_id").distinct().withColumn("h", P.share(7, "user_id")), "h")
    return pages.select("user_id", (F.col("pos") < int(n * 0.2)).alias("test"))


@query("SELECT user_id, (ntile(4) OVER (ORDER BY user_id) - 1)::INT AS part FROM (SELECT DISTINCT user_id FROM events)")
def split_horizontal(t):
    pages, n = P.positions(t.events.select("user_id").distinct(), "user_id")
    return pages.select("user_id", P.tile(F.col("pos"), n, 4).alias("part"))


@query("SELECT vec_id, unnest([0, 1, 2, 3]) AS part, round(unnest([list_sum(embedding[1:16]::DOUBLE[]), list_sum(embedding[17:32]::DOUBLE[]), list_sum(embedding[33:48]::DOUBLE[]), list_sum(embedding[49:64]::DOUBLE[])]), 5) AS total FROM embeddings")
def split_vertical(t):
    """Slices of the features; each is reported by its sum."""
    parts = F.array(*[F.aggregate(F.slice("embedding", 16 * k + 1, 16), F.lit(0.0), lambda s, x: s + x.cast("double")) for k in range(4)])
    return t.embeddings.select("vec_id", F.posexplode(parts).alias("part", "total")).select("vec_id", "part", F.round("total", 5).alias("total"))


@query("SELECT c_custkey, (ntile(7) OVER (ORDER BY c_custkey) - 1)::INT AS part FROM customer")
def page_slices(t):
    rows, n = P.positions(t.customer.select("c_custkey"), "c_custkey")
    return rows.select("c_custkey", P.tile(F.col("pos"), n, 7).alias("part"))


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT c_custkey, (pos >= round(n * 0.5))::INT + (pos >= round(n * 0.8))::INT AS part FROM r")
def weighted_slices(t):
    rows, n = P.positions(t.customer.select("c_custkey"), "c_custkey")
    return rows.select("c_custkey", P.weighted_tile(F.col("pos"), n, [5.0, 3.0, 2.0]).alias("part"))


@query(f"SELECT event_id FROM events WHERE {_share(3, 'event_id')} < 0.1")
def sample_fraction(t):
    return P.sample_fraction(t.events, 0.1, 3, "event_id").select("event_id")


@query(f"WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events), d AS (SELECT i AS draw, floor({_share(3, 'i')} * (SELECT count(*) FROM events))::BIGINT AS pos FROM range((SELECT count(*) // 2 FROM events)) x(i)) SELECT draw, event_id FROM d JOIN r USING (pos)")
def bootstrap(t):
    return P.bootstrap(t.events.select("event_id"), "event_id", 0.5, 3).select("draw", "event_id")


@query(f"SELECT event_id, CASE WHEN {_share(5, 'event_id')} >= 0.1 THEN value END AS value FROM events")
def data_dropout(t):
    return P.dropout(t.events.select("event_id", "value"), "value", 0.1, 5, "event_id")


@query(f"SELECT user_id, min_by(event_id, {_share(1, 'user_id', 'event_id')}) AS event_id FROM events GROUP BY 1")
def page_random_row(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", P.share(1, "user_id", "event_id")).alias("event_id"))


# Joins and rows


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def align_by_id(t):
    """An id of the attribute table without rows raises."""
    left, right = t.nation, t.region
    if not right.join(left, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").isEmpty():
        raise ValueError("an attribute id has no page")
    return left.join(right, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey + max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber AS rul FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def rul_lookup_join(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.max("l_linenumber").over(Window.partitionBy("l_orderkey")).alias("last"))
    return rows.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("o_custkey") + F.col("last") - F.col("l_linenumber")).alias("rul"))


@query("SELECT event_id FROM events WHERE ts IN (SELECT max(ts) FROM events GROUP BY user_id, event_type)")
def isin_time_semijoin(t):
    return t.events.join(t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts")), "ts", "left_semi").select("event_id")


LABELLED = "l AS (SELECT * FROM events WHERE user_id % 5 <> 0 AND event_type <> 'view'), g AS (SELECT avg(value) AS g FROM l), m AS (SELECT event_type, avg(value) AS m FROM l GROUP BY 1), k AS (SELECT user_id % 10 AS c, avg(value) AS k FROM l GROUP BY 1)"


def _cluster_mean(rows, labelled, cluster):
    """Mean label of the cluster, of all labelled rows where a cluster has none. The joined table has one row a cluster."""
    means = labelled.groupBy(cluster.alias("__c")).agg(F.avg("value").alias("__m"))
    whole = labelled.agg(F.avg("value").alias("__g"))
    return rows.withColumn("__k", cluster).join(means, F.col("__k") == F.col("__c"), "left").join(F.broadcast(whole)).withColumn("y", F.coalesce("__m", "__g")).drop("__c", "__k", "__m", "__g")


def _labelled(t):
    return t.events.filter("user_id % 5 <> 0 and event_type <> 'view'")


@query(f"WITH {LABELLED} SELECT event_id, round(coalesce(m, g), 5) AS y FROM events LEFT JOIN m USING (event_type), g")
def cluster_mean_join(t):
    return _cluster_mean(t.events, _labelled(t), F.col("event_type")).select("event_id", F.round("y", 5).alias("y"))


@query(f"WITH {LABELLED} SELECT event_id, round((coalesce(m, g) + coalesce(k, g)) / 2, 5) AS y FROM events LEFT JOIN m USING (event_type) LEFT JOIN k ON user_id % 10 = c, g")
def pseudo_label_ensemble(t):
    one = _cluster_mean(t.events, _labelled(t), F.col("event_type")).withColumnRenamed("y", "a")
    return _cluster_mean(one, _labelled(t), F.col("user_id") % 10).select("event_id", F.round((F.col("a") + F.col("y")) / 2, 5).alias("y"))


@query("WITH s AS (SELECT vec_id, list_aggregate(embedding::DOUBLE[], 'stddev_pop') AS s FROM embeddings) SELECT vec_id, round(s, 5) AS spread FROM s WHERE 1 / (s + 1e-6) > 1.01")
def pseudo_label_confident(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    mean = F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / F.size(e)
    rows = t.embeddings.select("vec_id", e.alias("e"), mean.alias("m"))
    spread = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / F.size("e"))
    return rows.select("vec_id", spread.alias("s")).filter(1 / (F.col("s") + 1e-6) > 1.01).select("vec_id", F.round("s", 5).alias("spread"))


@query(SOFT.replace("exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id)", "exp(-d / (SELECT stddev_pop(d) FROM d)) / sum(exp(-d / (SELECT stddev_pop(d) FROM d))) OVER (PARTITION BY vec_id)") + ", y AS (SELECT label AS centre, quantile_disc(embedding[1], 0.5)::DOUBLE AS y FROM embeddings GROUP BY 1) SELECT vec_id, round(sum(q * y), 5) AS p FROM q JOIN y USING (centre) GROUP BY 1")
def pseudo_label_soft(t):
    """Medians by cluster, weighted by softmax(-distance / deviation of all distances). The median keeps bounded memory and is exact for up to a million values a cluster."""
    d = _soft(t).drop("q")
    spread = d.agg(F.stddev_pop("d").alias("s"))
    y = t.embeddings.groupBy(F.col("label").alias("centre")).agg(F.percentile_approx(F.col("embedding")[0], 0.5, 1_000_000).cast("double").alias("y"))
    w = d.join(F.broadcast(spread)).withColumn("w", F.exp(-F.col("d") / F.col("s"))).join(y, "centre")
    return w.groupBy("vec_id").agg(F.round(F.sum(F.col("w") * F.col("y")) / F.sum("w"), 5).alias("p"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lead(l_quantity, 2) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) * l_quantity AS product FROM lineitem")
def lag_self_join(t):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.lead("l_quantity", 2).over(w) * F.col("l_quantity")).alias("product"))


@query("SELECT user_id, event_type AS code, coalesce(max(value), 0) AS confidence FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events) LEFT JOIN events USING (user_id, event_type) GROUP BY 1, 2")
def dense_code_vector(t):
    wide = t.events.groupBy("user_id").pivot("event_type").agg(F.max("value")).fillna(0.0)
    return wide.unpivot(["user_id"], [c for c in wide.columns if c != "user_id"], "code", "confidence")


@query("SELECT l_returnflag, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS value, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def grid_reshape(t):
    keys = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.selectExpr(*keys, "l_quantity quantity", "l_discount discount", "l_tax tax").unpivot(keys, ["quantity", "discount", "tax"], "feature", "value")


@query("SELECT a.vec_id, round(list_sum(list_concat(a.embedding, b.embedding)::DOUBLE[]), 4) AS total, len(list_concat(a.embedding, b.embedding)) AS width FROM embeddings a JOIN embeddings b USING (vec_id)")
def horizontal_concat(t):
    both = t.embeddings.select("vec_id", "embedding").join(t.embeddings.select("vec_id", F.col("embedding").alias("other")), "vec_id").withColumn("e", F.concat("embedding", "other"))
    return both.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), F.size("e").cast("bigint").alias("width"))


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def tile_repeat(t):
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")


# Vectors and clusters


@query(f"WITH p AS ({UNNEST}), c AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2), s AS (SELECT label, i, abs(m) / sum(abs(m)) OVER (PARTITION BY label) AS s FROM c) SELECT i::INT AS feature, round(sum(s), 6) AS share FROM s GROUP BY 1")
def feature_contribution(t):
    """Loadings are the class means: absolute share of each feature, summed over components."""
    _, centres = _centres(t)
    loads = np.abs(np.array(centres).reshape(len(centres), -1))
    shares = (loads / loads.sum(1, keepdims=True)).sum(0) if len(loads) else np.zeros(0)
    return t.spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(shares)], "feature int, share double").orderBy(F.desc("share"), "feature")


@query(f"WITH p AS ({UNNEST}), c AS (SELECT i, corr(x, label) AS r FROM p GROUP BY 1), k AS (SELECT * FROM c ORDER BY abs(r) DESC, i LIMIT 12) SELECT i::INT AS feature, round(abs(r), 6) AS score FROM k")
def top_k_features(t):
    """The fifth of the features that score best, worst of them first."""
    rows = t.embeddings.select("label", F.posexplode("embedding").alias("feature", "x"))
    score = rows.groupBy("feature").agg(F.abs(F.corr(F.col("x").cast("double"), F.col("label").cast("double"))).alias("s"))
    return score.orderBy(F.desc("s"), "feature").limit(max(1, int(20 * 64 / 100))).orderBy("s").select("feature", F.round("s", 6).alias("score"))


@query(f"SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("i"), F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    return t.embeddings.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a")).join(b, "i").select("i", "j", F.round(L.cosine(F.col("a"), F.col("b")), 5).alias("c"))


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS d FROM embeddings")
def dot(t):
    return t.embeddings.select("vec_id", F.round(V.dot(_vector(), _vector()), 5).alias("d"))


STEPS = "(SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS step FROM events)"


@query(f"SELECT event_id, step, round(1.0 + (0.1 - 1.0) * least(1.0, step / 40.0), 6) AS w FROM {STEPS}")
def schedule_linear(t):
    """The weight of each of a user's events, as a step of its series."""
    return EV.numbered(t.events, "step").select("event_id", "step", F.round(L.decay_linear(F.col("step"), 40, 1.0, 0.1), 6).alias("w"))


@query(f"SELECT event_id, step, round(0.1 + 0.5 * 0.9 * (1 + cos(pi() * least(1.0, step / 40.0))), 6) AS w FROM {STEPS}")
def schedule_cosine(t):
    return EV.numbered(t.events, "step").select("event_id", "step", F.round(L.decay_cosine(F.col("step"), 40, 1.0, 0.1), 6).alias("w"))


@query("SELECT o_orderkey, round((o_totalprice - m) / s, 4) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def standardize_targets(t):
    s = t.orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
    return t.orders.join(F.broadcast(s)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 4).alias("z"))


@query("WITH u AS (SELECT o_totalprice AS x FROM orders UNION ALL SELECT l_extendedprice FROM lineitem), s AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM u) SELECT o_orderkey, round((o_totalprice - m) / s, 4) AS z FROM orders, s")
def standardize_union(t):
    s = t.orders.select(F.col("o_totalprice").alias("x")).unionByName(t.lineitem.select(F.col("l_extendedprice").alias("x"))).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return t.orders.join(F.broadcast(s)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 4).alias("z"))


@query(SOFT + ", s AS (SELECT centre, avg(q) AS m, stddev_pop(q) AS s FROM q GROUP BY 1) SELECT vec_id, centre, round((q - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 4) AS z FROM q JOIN s USING (centre)")
def soft_assign(t):
    q = _soft(t)
    s = q.groupBy("centre").agg(F.avg("q").alias("m"), F.stddev_pop("q").alias("s"))
    return q.join(F.broadcast(s), "centre").select("vec_id", "centre", F.round((F.col("q") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 4).alias("z"))


@query(CENTRES + " SELECT vec_id, centre, (row_number() OVER (PARTITION BY vec_id ORDER BY d, centre) = 1)::INT AS hit FROM d")
def hard_assign(t):
    labels, centres = _centres(t)
    own = t.embeddings.select("vec_id", L.nearest(L.distances_to(_vector(), centres)).alias("k"))
    return own.select("vec_id", "k", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("at", "centre")).select("vec_id", "centre", (F.col("at") == F.col("k")).cast("int").alias("hit"))


@query(SOFT + ", w AS (SELECT vec_id, centre, q * q / sum(q) OVER (PARTITION BY centre) AS w FROM q) SELECT vec_id, centre, round(w / sum(w) OVER (PARTITION BY vec_id), 5) AS p FROM w")
def target_distribution(t):
    q = _soft(t)
    w = q.join(F.broadcast(q.groupBy("centre").agg(F.sum("q").alias("s"))), "centre").withColumn("w", F.col("q") * F.col("q") / F.col("s"))
    return w.select("vec_id", "centre", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("vec_id")), 5).alias("p"))


@query("WITH r AS (SELECT event_type, stddev_pop(value) AS r FROM events GROUP BY 1) SELECT event_type, round(1.0 / count(*) OVER (), 6) AS uniform, round((1 / r) / sum(1 / r) OVER (), 6) AS inverse, round(exp(1 / r) / sum(exp(1 / r)) OVER (), 6) AS soft FROM r")
def encoder_weights(t):
    """A row an encoder (here: an event type with its deviation as RMSE), so one window holds them."""
    r, whole = t.events.groupBy("event_type").agg(F.stddev_pop("value").alias("r")), Window.partitionBy()
    parts = {"uniform": F.lit(1.0), "inverse": 1 / F.col("r"), "soft": F.exp(1 / F.col("r"))}
    return r.select("event_type", *[F.round(w / F.sum(w).over(whole), 6).alias(n) for n, w in parts.items()])


# Distances between samples and spread of latents


@query(f"SELECT i::INT AS dim, round(avg(0.5 * (x * x + exp(x / 2) - x / 2 - 1)), 6) AS kl FROM ({UNNEST}) GROUP BY 1")
def kl_per_dim(t):
    """Means are the vector's entries, log variances half of them."""
    rows = t.embeddings.select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy("dim").agg(F.round(F.avg(L.kl_to_normal(F.col("x"), F.col("x") / 2)), 6).alias("kl"))


@query(f"SELECT count(*)::BIGINT AS n FROM (SELECT avg(0.5 * (x * x + exp(x / 2) - x / 2 - 1)) AS kl FROM ({UNNEST}) GROUP BY i) WHERE kl > 0.1")
def active_latents(t):
    rows = t.embeddings.select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy("dim").agg(F.avg(L.kl_to_normal(F.col("x"), F.col("x") / 2)).alias("kl")).filter("kl > 0.1").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(stddev_pop(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)), 5) AS s FROM embeddings")
def angular_std(t):
    return t.embeddings.agg(F.round(F.stddev_pop(F.atan2(_vector()[1].cast("double"), _vector()[0].cast("double"))), 5).alias("s"))


UNIT = f"WITH p AS ({UNNEST}), u AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM p), m AS (SELECT i, avg(x) AS m, sum(x) AS s FROM u GROUP BY 1)"


def _unit(t):
    size = F.sqrt(V.dot(_vector(), _vector()))
    return t.embeddings.select("vec_id", F.transform(_vector(), lambda x: x.cast("double") / size).alias("u")).filter(F.isnan(F.col("u")[0]) == F.lit(False))


@query(UNIT + ", c AS (SELECT vec_id, sum(x * m) / (SELECT sqrt(sum(m * m)) FROM m) AS c FROM u JOIN m USING (i) GROUP BY 1) SELECT round(var_samp(acos(greatest(-1, least(1, c)))), 6) AS v FROM c")
def angular_variance(t):
    u = _unit(t)
    mean = [r["m"] for r in u.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]  # one number a dimension
    c = L.cosine(F.col("u"), F.array(*[F.lit(x) for x in mean]))
    return u.agg(F.round(F.var_samp(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))), 6).alias("v"))


@query(UNIT + " SELECT round(((SELECT sum(s * s) FROM m) - n) / (n * (n - 1)), 6) AS c FROM (SELECT count(*)::DOUBLE AS n FROM embeddings)")
def mean_cosine(t):
    """Of all pairs without forming one: the squared length of the unit vectors' sum holds every pair twice and each vector once."""
    u = _unit(t)
    s = u.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s"))
    return u.agg(F.count(F.lit(1)).cast("double").alias("n")).join(s).select(F.round((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("c"))


def _over_pairs(t, run, schema):
    """What run makes of two blocks of all vectors: of both, chunks of distances with the pairs that count, and whether the block meets itself."""

    def each(q, r, same):
        return run(q, r, ((at, np.sqrt(x), other & known) for at, x, other, known in V.compared(q, r, V.squares, ("embedding",))), same)

    return V.among(t.embeddings.filter("embedding is not null"), each, schema, block=4096)


@query(PAIRS + ", k AS (SELECT i_, ln(avg(exp(-d * d / 2))) - 32 * ln(2 * pi()) AS k FROM d GROUP BY 1) SELECT round(-avg(k), 4) AS entropy FROM k")
def kde_entropy(t):
    """Gaussian kernel of width 1 in 64 dimensions, at every vector; a vector counts for itself, with 1."""

    def run(q, r, chunks, same):
        sides = [(np.zeros(len(x)), np.zeros(len(x), np.int64)) for x in (q, r)]
        for at, d, counts in chunks:
            near = np.where(counts, np.exp(-d * d / 2), 0.0)
            for to, found in zip(sides[0], (near, counts), strict=True):
                to[at : at + len(d)] = found.sum(1)
            for to, found in zip(sides[1], (near, counts), strict=True):
                to += found.sum(0)
        return pa.concat_tables([pa.table({"i": ids, "s": pa.array(s), "n": pa.array(n)}) for ids, (s, n) in zip((q.column("i"), r.column("j")), sides, strict=True)][: 1 if same else 2])

    sums = _over_pairs(t, run, f"i {t.embeddings.schema['vec_id'].dataType.simpleString()}, s double, n long")
    k = sums.groupBy("i").agg((F.ln((F.sum("s") + 1) / (F.sum("n") + 1)) - 32 * F.ln(2 * F.pi())).alias("k"))
    return k.agg(F.round(-F.avg("k"), 4).alias("entropy"))


@query(PAIRS + " SELECT round(avg(d), 5) AS mean, round(stddev_samp(d), 5) AS std FROM d WHERE i_ <> j_")
def pairwise_distance_stats(t):
    """From count, mean and squares about the mean of every group of pairs; both orders of a pair count."""

    def run(q, r, chunks, same):
        times = 1 if same else 2
        parts = [(times * len(d), d.mean(), times * ((d - d.mean()) ** 2).sum()) for d in (d[counts] for _, d, counts in chunks) if len(d)]
        n, m, s = zip(*parts, strict=True) if parts else ((), (), ())
        return pa.table({"n": pa.array(n, pa.int64()), "m": pa.array(m, pa.float64()), "s": pa.array(s, pa.float64())})

    got = _over_pairs(t, run, "n long, m double, s double").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("s") + F.col("n") * F.col("m") * F.col("m")).alias("s"))
    mean = F.col("t") / F.col("n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("s") - F.col("t") * mean) / (F.col("n") - 1)))
    return got.select(F.round(mean, 5).alias("mean"), F.round(spread, 5).alias("std"))


SPHERE = f"WITH p AS ({UNNEST}), a AS (SELECT vec_id, i, x, CASE WHEN i < 3 THEN x / sqrt(sum(CASE WHEN i < 3 THEN x * x END) OVER (PARTITION BY vec_id)) END AS u FROM p)"


@query(SPHERE + f" SELECT a.vec_id AS i_, b.vec_id AS j_, round(acos(greatest(-1, least(1, sum(a.u * b.u)))) + sqrt(sum(CASE WHEN i >= 3 THEN (a.x - b.x) * (a.x - b.x) END)), 4) AS d FROM a JOIN a b USING (i) WHERE a.{ASKED} AND a.vec_id <> b.vec_id GROUP BY 1, 2")
def product_distance(t):
    """Great circle on the first three entries, scaled to the sphere, plus L2 on the rest; the stated query set against all."""
    on = F.slice("embedding", 1, 3)
    size = F.sqrt(V.dot(on, on))
    parts = t.embeddings.select("vec_id", F.transform(on, lambda x: x.cast("double") / size).alias("u"), F.slice("embedding", 4, 61).alias("v"))
    arc = lambda qu, qv, u, v: np.arccos(np.clip(V.dots(qu, u), -1, 1)) + np.sqrt(V.squares(qv, v))
    pairs = V.pairs(parts.filter(ASKED), parts, arc, vectors=("u", "v"))
    return pairs.select(F.col("i").alias("i_"), F.col("j").alias("j_"), F.round("x", 4).alias("d"))


def _half(t, upper: bool):
    return t.embeddings.filter("label >= 5" if upper else "label < 5")


@query()
def frechet_distance(t):
    d = M.frechet(M.moments(_half(t, False), _vector()), M.moments(_half(t, True), _vector()))
    return t.spark.createDataFrame([(d,)], "frechet double")


@query()
def mmd_rbf(t):
    return M.mmd_rbf(t.embeddings, _vector(), 64, (F.col("label") >= 5).cast("int"), 0.05)


@query()
def sliced_wasserstein(t):
    """Mean squared gap of both samples' quantiles (255 of them, bounded sketches) over 8 seeded directions; no sample is sorted in one task."""
    way = np.random.default_rng(0).normal(size=(8, 64))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    at = [k / 256 for k in range(1, 256)]
    flat = [F.percentile_approx(V.dot(_vector(), F.array(*[F.lit(float(x)) for x in w])), at, 10_000).alias(f"q{k}") for k, w in enumerate(way)]
    got = t.embeddings.groupBy((F.col("label") >= 5).alias("side")).agg(*flat)
    a, b = got.filter("not side"), got.filter("side").select(*[F.col(f"q{k}").alias(f"r{k}") for k in range(8)])
    gap = lambda k: F.aggregate(F.zip_with(f"q{k}", f"r{k}", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / 255
    return a.join(b).select((sum(gap(k) for k in range(8)) / 8).alias("distance"))


@query()
def zscore_test(t):
    """Mean z of the mean of 100 hashed tenths, all in one aggregate; a deviation below 1e-8 gives 0."""
    draws = [F.avg(F.when(P.share(k, "event_id") < 0.1, F.col("value"))).alias(f"m{k}") for k in range(100)]
    sizes = [F.sum((P.share(k, "event_id") < 0.1).cast("int")).alias(f"n{k}") for k in range(100)]
    row = t.events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), *draws, *sizes)
    z = sum(F.coalesce(F.abs(F.col(f"m{k}") - F.col("m")) / (F.col("s") / F.sqrt(f"n{k}")), F.lit(0.0)) for k in range(100)) / 100
    return row.select(F.when(F.col("s") < 1e-8, 0.0).otherwise(z).alias("z"))


# Series


@query(f"WITH a AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS x, ts, event_id FROM events), b AS (SELECT *, lead(x, 1) OVER w AS l1, lead(x, 2) OVER w AS l2, lead(x, 3) OVER w AS l3 FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT user_id, unnest([1, 2, 3]) AS lag, unnest([sum(x * l1), sum(x * l2), sum(x * l3)]) / sum(x * x) AS acf FROM b GROUP BY user_id) SELECT a.user_id, round(sqrt(sum((a.acf - b.acf) ** 2)), 5) AS l2, round(sqrt(avg((a.acf - b.acf) ** 2)), 5) AS rmsd FROM c a JOIN c b ON b.user_id = a.user_id + 1 AND a.lag = b.lag GROUP BY 1")
def acf_distance(t):
    """Of each series and the next key's, over common lags: the length of the gap and its root mean square."""
    c = S.acf(t.events, EV, "value", [1, 2, 3])
    gap = c.join(c.select((F.col("user_id") - 1).alias("user_id"), "lag", F.col("acf").alias("other")), ["user_id", "lag"]).withColumn("g", F.pow(F.col("acf") - F.col("other"), 2))
    return gap.groupBy("user_id").agg(F.round(F.sqrt(F.sum("g")), 5).alias("l2"), F.round(F.sqrt(F.avg("g")), 5).alias("rmsd"))


def _lttb(t, column):
    return G.lttb(t.events.select("user_id", "ts", "event_id", column.alias("v")), EV, "v", 20).select("user_id", "event_id")


@query()
def lttb_intersection(t):
    return _lttb(t, F.col("value")).intersect(_lttb(t, F.col("event_id").cast("double") % 97))


@query()
def lttb_union_spikes(t):
    s = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    spikes = t.events.join(s, "user_id").filter("s > 0 and abs(value - m) / s > 3").select("user_id", "event_id")
    return _lttb(t, F.col("value")).unionByName(spikes).distinct()


@query()
def resample_pchip(t):
    return X.resample_pchip(t.events.select("user_id", "ts", "event_id", "value"), EV, "ts", "value", 6 * 3600.0)


def _filtered(t, f):
    return X.filtered(t.events.select("user_id", "ts", "event_id", "value"), EV, "value", f).select("event_id", "value")


@query()
def denoise_psd(t):
    return _filtered(t, lambda y: X.spectral_mask(y, 0.2))


@query()
def denoise_bandpass(t):
    return _filtered(t, lambda y: X.butterworth_gain(y, 0.02, 0.2))


@query()
def lowpass(t):
    return _filtered(t, lambda y: X.butterworth_gain(y, 0.0, 0.1))


@query("""WITH RECURSIVE l AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events),
m AS (SELECT user_id, regr_slope(value, x) AS a, regr_intercept(value, x) AS b, max_by(value, (ts, event_id)) AS last FROM l GROUP BY 1),
f AS (SELECT user_id, a, b, 1 AS step, last * a + b AS y FROM m UNION ALL SELECT user_id, a, b, step + 1, y * a + b FROM f WHERE step < 5)
SELECT user_id, step::INT AS step, round(y, 4) AS forecast FROM f""")
def recursive_forecast(t):
    return S.recursive_forecast(t.events, EV, "value", 5).select("user_id", "step", F.round("forecast", 4).alias("forecast"))


# Models


def _parts(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *LINEAR, "l_extendedprice")
    return rows.filter("l_orderkey % 5 <> 0"), rows.filter("l_orderkey % 5 = 0")


def _errors(scored, target):
    miss = F.col(target) - F.col("prediction")
    return scored.agg(F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"))


@query()
def fit_ridge(t):
    """Two targets on two features, from one pass of moments."""
    train, test = _parts(t)
    features, targets = LINEAR[:2], ["l_tax", "l_extendedprice"]
    coef, intercept = M.ridge(M.moments(train, F.array(*features, *targets)), 1.0, len(targets))
    each = [_errors(test.withColumn("prediction", M.linear(features, coef[:, j], intercept[j])), y).select(F.lit(y).alias("target"), "rmse", "mae") for j, y in enumerate(targets)]
    return each[0].unionByName(each[1])


@query()
def ridge_alpha_search(t):
    return t.spark.createDataFrame(M.ridge_alpha_search(*_parts(t), LINEAR, "l_extendedprice"), "alpha double, rmse double, mae double")


def _fitted(kind):
    """A model for each target; the forest, whose trees are deep, has one."""

    def run(t):
        targets, features = (["l_extendedprice"], LINEAR) if kind == "random_forest" else (["l_extendedprice", "l_tax"], LINEAR[:2])
        each = [_errors(M.fit_predict(*_parts(t), features, y, kind), y).select(F.lit(y).alias("target"), "rmse", "mae") for y in targets]
        return each[0] if len(each) == 1 else each[0].unionByName(each[1])

    return run


for _kind in ("elasticnet", "random_forest", "boosting"):
    query(name=f"fit_{_kind}")(_fitted(_kind))


@query()
def fit_logistic(t):
    """Three classes, one against the rest each."""
    price = F.col("l_extendedprice")
    rows = t.lineitem.select("l_orderkey", *LINEAR, F.when(price > 60000, 2.0).when(price > 30000, 1.0).otherwise(0.0).alias("y"))
    scored = M.fit_predict(rows.filter("l_orderkey % 5 <> 0"), rows.filter("l_orderkey % 5 = 0"), LINEAR, "y", "logistic")
    return scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))


@query()
def mutual_info_select(t):
    return t.spark.createDataFrame(M.mutual_info_select(t.lineitem, LINEAR, "l_extendedprice", 40), "feature string, score double")


@query()
def pca_fit(t):
    vectors, shares = M.components(M.moments(t.embeddings, _vector()))
    k = M.components_for(shares, 0.95)
    return t.embeddings.select("vec_id", F.array(*[V.dot(_vector(), F.array(*[F.lit(float(x)) for x in v])) for v in vectors[:k]]).alias("projected"))


@query()
def pca_components_for_variance(t):
    _, shares = M.components(M.moments(t.embeddings, _vector()))
    return t.spark.createDataFrame([(level, M.components_for(shares, level)) for level in (0.9, 0.95)], "level double, components int")


@query()
def kmeans_fit(t):
    return t.embeddings.select("vec_id", L.nearest(L.distances_to(_vector(), M.kmeans_centres(t.embeddings, "embedding", 8))).alias("cluster"))


@query()
def kmeans_best_k(t):
    return t.spark.createDataFrame([(M.kmeans_best_k(t.embeddings, "embedding", 2, 5),)], "k int")


@query()
def cluster_score(t):
    return t.spark.createDataFrame([tuple(M.cluster_score(t.embeddings, "embedding", _centres(t)[1]).values())], "calinski_harabasz double, davies_bouldin double")


# Files: a table is written in the form, then read by the reader


def _csv(t, tag):
    path = R.scratch(t.spark, tag)
    t.nation.repartition("n_regionkey").sortWithinPartitions("n_nationkey").write.option("header", True).csv(path)
    return path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv(t):
    return t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("header", True).csv(_csv(t, "csv"))


@query("SELECT n_regionkey AS page, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::BIGINT AS step, n_nationkey, n_name FROM nation")
def scan_csv_folder_pages(t):
    path = R.scratch(t.spark, "pages")
    for k in range(5):  # one file a page, named in order
        t.nation.filter(F.col("n_regionkey") == k).select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey").write.option("header", True).csv(f"{path}/{k}")
    return R.csv_pages(t.spark, f"{path}/*", "n_nationkey int, n_name string")


@query("SELECT n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b, NULL::DOUBLE AS c FROM nation")
def scan_whitespace_text(t):
    path = R.scratch(t.spark, "text")
    t.nation.select(F.concat_ws("   ", F.lit(" "), "n_nationkey", "n_regionkey")).write.text(path)
    return R.whitespace_text(t.spark, path, ["a", "b", "c"])


@query("SELECT vec_id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def scan_tsv_labelled(t):
    path = R.scratch(t.spark, "tsv")
    doubles = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    t.embeddings.select(F.concat_ws("\t", "label", F.col("vec_id").cast("string"), F.array_join(doubles, "\t"))).write.text(path)
    rows = R.labelled_tsv(t.spark, path)
    return rows.select(F.col("values")[0].cast("bigint").alias("vec_id"), "label", F.round(F.aggregate(F.slice("values", 2, 64), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    """
    WITH cells AS (SELECT vec_id % 5 = 0 AS test, (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::INT AS label, embedding FROM embeddings),
    each AS (SELECT test, label, ((k - 1) // 16)::INT AS channel, embedding[k]::DOUBLE AS x FROM cells, range(1, 65) r(k)),
    law AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS s FROM each WHERE NOT test GROUP BY 1)
    SELECT test, label, channel, count(*) AS n, round(avg((x - m) / s) + 10, 4) AS mean, round(avg(((x - m) / s) ^ 2), 4) AS square FROM each JOIN law USING (channel) GROUP BY 1, 2, 3
    """
)
def scan_arff(t):
    path = R.scratch(t.spark, "arff")
    channel = lambda k: F.array_join(F.transform(F.slice("embedding", 16 * k + 1, 16), lambda x: x.cast("double").cast("string")), ",")
    line = F.concat(F.lit("'"), F.concat_ws("\\n", *[channel(k) for k in range(4)]), F.lit("',"), F.col("label").cast("string"))
    heads = t.spark.createDataFrame([("@relation series",), (" @attribute t0 numeric",), ("@data",)], "value string").coalesce(1)
    t.embeddings.select((F.col("vec_id") % 5 == 0).alias("test"), line.alias("value")).write.partitionBy("test").text(path)
    heads.write.mode("append").text(f"{path}/test=false")
    rows = R.relational_arff(t.spark, f"{path}/*").withColumn("test", F.col("path").contains("/test=true/"))
    each = R.standardized(rows, rows.filter(~F.col("test"))).select("test", "label", F.posexplode("values").alias("channel", "xs")).select("test", "label", "channel", F.explode("xs").alias("x"))
    return each.groupBy("test", "label", "channel").agg(F.count("*").alias("n"), F.round(F.avg("x") + 10, 4).alias("mean"), F.round(F.avg(F.col("x") * F.col("x")), 4).alias("square"))


@query("SELECT n_nationkey FROM nation WHERE (n_nationkey + 1) % 3 <> 1")
def csv_stride_read(t):
    path = R.scratch(t.spark, "stride")
    t.nation.coalesce(1).sortWithinPartitions("n_nationkey").select("n_nationkey").write.option("header", True).csv(path)
    return R.csv_stride(t.spark, path, 3, "n_nationkey int")


@query("SELECT o_custkey AS method, round(avg(o_totalprice), 2) AS mean, round(stddev_pop(o_totalprice), 2) AS std FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE n >= 3 AND n % 3 = 0 AND r <= 3 GROUP BY 1")
def sink_latex_summary(t):
    s = R.run_summary(t.orders, 3, "o_custkey", "o_orderkey", "o_totalprice")
    return s.select(F.col("o_custkey").alias("method"), F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


@query("SELECT n_name, n_nationkey FROM nation UNION ALL SELECT n_name, n_nationkey FROM nation")
def sink_csv_append(t):
    path = R.scratch(t.spark, "append")
    for _ in range(2):
        R.append_run(t.nation.select("n_name", "n_nationkey"), path)
    return t.spark.read.schema("n_name string, n_nationkey int").option("header", True).csv(path)


@query("SELECT n_nationkey AS id, n_regionkey::DOUBLE AS x FROM nation")
def source_http_ephemeris(t):
    """The parsing half: a report's rows between its marks. Fetching is left to the caller."""
    report = F.concat(F.lit("header\n$$SOE\n"), F.concat_ws(", ", "n_nationkey", "n_regionkey"), F.lit("\n$$EOE\nfooter"))
    return t.nation.select(F.explode(R.parse_report(report, "id int, x double")).alias("r")).select("r.*")
