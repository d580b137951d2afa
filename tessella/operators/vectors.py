"""Array algebra, neighbour joins and distribution comparison.

Pairs of all rows are made by pairs of blocks, pairs of a stated query set and all rows block by part: a group holds a block of queries and a part of the rows
as matrices, and sums run over the places of a vector from first to last, as SQL's do. What leaves a group is its pairs,
or only what they add up to."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


#: Queries a row meets at once.
BLOCK = 512


def met(queries: DataFrame, rows: DataFrame, id_: str = "vec_id", keep: tuple[str, ...] = ("embedding",), block: int = BLOCK) -> DataFrame:
    """Every row of a stated query set with every row of a table but itself: i, j and the kept columns as i_ and j_. The queries are dealt to blocks of about `block`, each one row of a small table by (block, part);
    table rows go to every block, dealt to parts by their id, and meet it by equality. Null ids meet nothing."""
    spark = rows.sparkSession
    blocks, parts = max(1, -(-queries.count() // block)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.filter(F.col(id_).isNotNull()).select(F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("__b"), F.struct(F.col(id_).alias("i"), *[F.col(c).alias(f"i_{c}") for c in keep]).alias("__q"))
    q = q.groupBy("__b").agg(F.collect_list("__q").alias("__qs")).withColumn("__p", each)
    r = rows.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("j"), *[F.col(c).alias(f"j_{c}") for c in keep], F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int").alias("__p"))
    r = r.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = r.join(q, ["__b", "__p"]).withColumn("__q", F.explode("__qs")).select("__q.*", "j", *[f"j_{c}" for c in keep])
    return pairs.filter("i <> j")


def matrix(v: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which are known: one that is null, holds a null or is shorter than the longest is NaN."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.asarray(pc.fill_null(pc.list_value_length(v), 0))
    width = int(size.max(initial=0))
    flat = v.flatten()
    if not flat.null_count and (size == width).all():
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(v), width), size == width
    rows = [r if r is not None and len(r) == width and None not in r else None for r in v.to_pylist()]
    return np.array([[np.nan] * width if r is None else r for r in rows], float).reshape(len(v), width), np.array([r is not None for r in rows], bool)


def _summed(q: np.ndarray, x: np.ndarray, difference: bool) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    a, b = np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
    rows = max(1, (1 << 15) // max(1, len(x)))  # what fits a core's cache
    step = np.empty((rows, len(x)))
    for at in range(0, len(q), rows):
        part = out[at : at + rows]
        held = step[: len(part)]
        for u, w in zip(a[:, at : at + rows], b, strict=False):  # of unequal widths no row of the shorter is known
            if difference:
                np.subtract(u[:, None], w, out=held)
                np.multiply(held, held, out=held)
            else:
                np.multiply(u[:, None], w, out=held)
            part += held
    return out


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q and x, summed from the first place to the last."""
    return _summed(q, x, True)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _summed(q, x, False)


def blockwise(queries: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, id_: str = "vec_id", keep: tuple[str, ...] = ("embedding",), block: int = 2048, part: int = 16384) -> DataFrame:
    """What run makes of each block of the queries (i, i_...) and each part of the rows (j, j_...). Both are dealt by a hash of their ids; null ids meet nothing. A row is moved once for each `block` queries."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-queries.count() // block))
    parts = max(-(-rows.count() // part), -(-tasks // blocks))
    dealt = lambda n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = lambda df, a: df.filter(F.col(id_).isNotNull()).select(F.col(id_).alias(a), *[F.col(c).alias(f"{a}_{c}") for c in keep], dealt(blocks if a == "i" else parts).alias("__b" if a == "i" else "__p"))
    key = ["__b", "__p"]
    q, r = named(queries, "i").withColumn("__p", each(parts)), named(rows, "j").withColumn("__b", each(blocks))
    return q.repartition(tasks, *key).groupBy(*key).cogroup(r.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, schema)


def compared(q: pa.Table, r: pa.Table, of: Callable[..., np.ndarray], vectors: tuple[str, ...]):
    """Chunk by chunk: the first query's place, values of its chunk's pairs, and which pairs there are (not of a row with itself) and are known."""
    own, ids = q.column("i").to_numpy(zero_copy_only=False), r.column("j").to_numpy(zero_copy_only=False)
    left, right = [matrix(q.column(f"i_{c}")) for c in vectors], [matrix(r.column(f"j_{c}")) for c in vectors]
    known = [np.logical_and.reduce([k for _, k in side]) if len(side[0][1]) else np.zeros(0, bool) for side in (left, right)]
    same = all(a.shape[1] == b.shape[1] for (a, _), (b, _) in zip(left, right, strict=True))
    step = max(1, (1 << 20) // max(1, len(ids)))
    for at in range(0, len(own) if len(ids) else 0, step):
        values = of(*[x[at : at + step] for x, _ in left], *[x for x, _ in right])
        yield at, values, own[at : at + step, None] != ids, (known[0][at : at + step, None] & known[1]) & same


def among(rows: DataFrame, run: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, id_: str = "vec_id", keep: tuple[str, ...] = ("embedding",), block: int = 8192) -> DataFrame:
    """What run makes of every pair of blocks of the rows, as i, i_... and j, j_...: of a block with itself (True), which holds each pair of rows in both orders, and of two blocks (False), which meet once. Null ids meet nothing. A row is moved once a block."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    known = rows.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), *keep)
    n = known.count()
    blocks = max(1, -(-n // block), min(n // 256, int(np.ceil(np.sqrt(2 * tasks)))))
    dealt = known.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"__lo": F.least("__b", "__o"), "__hi": F.greatest("__b", "__o")}).drop("__o")

    def meet(t: pa.Table) -> pa.Table:
        at, lo, hi = (t.column(c).to_numpy() for c in ("__b", "__lo", "__hi"))
        side = lambda mask, a: pa.table({a: t.column("id").filter(pa.array(mask)), **{f"{a}_{c}": t.column(c).filter(pa.array(mask)) for c in keep}})
        return run(side(at == lo, "i"), side(at == hi, "j"), bool(lo[0] == hi[0]))

    return dealt.repartition(tasks, "__lo", "__hi").groupBy("__lo", "__hi").applyInArrow(meet, schema)


def pairs(queries: DataFrame, rows: DataFrame, of: Callable[..., np.ndarray], id_: str = "vec_id", vectors: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """i, j, x: of(query matrices..., row matrices...) of every query and every row but itself; null for a vector that is null or holds one."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        i, j, x, null = [], [], [], []
        for at, values, other, known in compared(q, r, of, vectors):
            a, b = np.nonzero(other)
            i.append(a + at)
            j.append(b)
            x.append(values[other])
            null.append(~known[other])
        put = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        return pa.table({"i": q.column("i").take(pa.array(put(i, np.int64))), "j": r.column("j").take(pa.array(put(j, np.int64))), "x": pa.array(put(x, float), mask=put(null, bool))})

    return blockwise(queries, rows, run, f"i {kind}, j {kind}, x double", id_, vectors, part=1024)


def knn(queries: DataFrame, rows: DataFrame, k: int, id_: str = "vec_id", vec: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """k nearest rows by L2 of each query, itself excluded; ties by id. For a stated query set against all rows: every group keeps its own k best before the shuffle. Vectors that are null or hold a null or NaN are no one's neighbours."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_, *keep)}
    schema = ", ".join([*[f"{a} {kinds[id_]}" for a in "ij"], *[f"{a}_{c} {kinds[c]}" for a in "ij" for c in keep], "d double"])

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        i, j, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        place = np.argsort(np.argsort(r.column("j").to_numpy(zero_copy_only=False), kind="stable"))
        for at, values, other, known in compared(q, r, squares, (vec,)):
            values[~(other & known) | np.isnan(values)] = np.inf
            take = min(k, values.shape[1])
            least = np.partition(values, take - 1, axis=1)[:, take - 1 :][:, :1] * (1 + 1e-15)  # roots may be equal where squares aren't
            a, b = np.nonzero((values <= least) & (values < np.inf))
            root = np.sqrt(values[a, b])
            order = np.lexsort((place[b], root, a))
            a, b, root = a[order], b[order], root[order]
            first = np.arange(len(a)) - np.searchsorted(a, a) < k
            i.append(a[first] + at)
            j.append(b[first])
            d.append(root[first])
        i, j = pa.array(np.concatenate(i)), pa.array(np.concatenate(j))
        out = {"i": q.column("i").take(i), "j": r.column("j").take(j)}
        for c in keep:
            out[f"i_{c}"] = q.column(f"i_{c}").take(i)
        for c in keep:
            out[f"j_{c}"] = r.column(f"j_{c}").take(j)
        return pa.table(out | {"d": pa.array(np.concatenate(d))})

    found = blockwise(queries, rows, run, schema, id_, (vec, *keep))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= k)


def cdf_table(df: DataFrame, keys: tuple[str, ...], value: str, side: str) -> DataFrame:
    """For each key and distinct value: both samples' cumulative shares and the gap to the next value. side is 0 or 1."""
    per = df.groupBy(*keys, value).agg(F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("b"))
    w = Window.partitionBy(*keys)
    run = w.orderBy(value)
    return per.select(*keys, value, (F.sum("a").over(run) / F.sum("a").over(w)).alias("fa"), (F.sum("b").over(run) / F.sum("b").over(w)).alias("fb"), (F.lead(value).over(run) - F.col(value)).alias("step"))
