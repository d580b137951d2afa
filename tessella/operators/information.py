"""Mutual information of two columns by nearest neighbours (Kraskov, Stoegbauer and Grassberger, first estimator).

For each row: the distance r to its k-th neighbour in the plane, by the larger of both differences, then the rows nearer
than r along each axis alone. No pairs of rows are made. The plane is cut into stripes of about sqrt(n * `ACROSS`)
rows; within a stripe, rows are sorted along it and each looks at so many neighbours in that order as can still be
nearer; where values along it repeat, rows of one value are searched across instead. That bounds r; a row whose bound crosses its stripe's edge visits the stripes that it may reach, each of which
answers with its k nearest there, and the least k of all count. Rows along an axis are counted by place within ranges of
sorted values; only of rows that reach beyond their range are r's two ends dealt like values, and added up by row.

Both columns are scaled to unit deviation and get hashed noise of 1e-10, so that ties fall apart, as is usual for this
estimator. Stripes lie across the column with more distinct values. Rows with a null or NaN are left out; fewer than
k + 2 rows, or a column of one value, have no information (0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .augment import normal
from .settle import dropped, settled

ACROSS = 64
#: In deviations: values closer than that are one but for the noise.
ALIKE = 1e-7
#: Rows of a range of sorted values.
RANGE = 1_000_000


def digamma(m: Column) -> Column:
    """Of a whole number from 1."""
    small = [-0.5772156649015329]
    for k in range(1, 12):
        small.append(small[-1] + 1 / k)
    m = m.cast("double")
    large = F.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6)
    return F.when(m <= len(small), F.get(F.array(*[F.lit(x) for x in small]), (m - 1).cast("int"))).otherwise(large)


def _place(cuts: list[float]):
    """How many cuts lie below a value: its stripe or range."""
    held = np.array(cuts)

    @F.arrow_udf(IntegerType())
    def place(v: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(held, v.to_numpy(zero_copy_only=False)).astype(np.int32))

    return place


def _cuts(df: DataFrame, column: str, parts: int) -> list[float]:
    if parts < 2:
        return []
    got = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("c")).first()["c"]
    return sorted(set(got or []))


def nearest_in(v: np.ndarray, w: np.ndarray, qv: np.ndarray, qw: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
    """For each query its k least distances (infinite beyond its bound) among rows sorted by w; own: the query's own place among them, or -1."""
    best = np.full((len(qv), k), np.inf)
    at = np.searchsorted(w, qw)
    for side in (-1, 1):
        place = at - 1 if side < 0 else at.copy()
        live = np.arange(len(qv))
        while len(live):
            p = place[live]
            inside = (p >= 0) & (p < len(w))
            live, p = live[inside], p[inside]
            gap = np.abs(w[p] - qw[live])
            near = gap <= np.minimum(best[live, -1], bound[live])
            live, p, gap = live[near], p[near], gap[near]
            d = np.maximum(gap, np.abs(v[p] - qv[live]))
            better = (d < best[live, -1]) & (p != own[live])
            rows = live[better]
            best[rows, -1] = d[better]
            best[rows] = np.sort(best[rows], axis=1)
            place[live] += side
    return best


def nearest_of_all(v: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Each row's k least distances to the others; rows sorted by w. Values of w that are alike but for the noise make long runs, in which order along w tells nothing: a run is searched along v, and only rows that may reach another run along w too."""
    n = len(v)
    gap = np.diff(w) > ALIKE
    run = np.concatenate([[0], np.cumsum(gap)])
    whole = np.full(n, np.inf)
    if not n or run[-1] + 1 > n / (8 * k):
        return np.vstack([nearest_in(v, w, v[a : a + 50_000], w[a : a + 50_000], np.arange(a, min(n, a + 50_000)), k, whole[a : a + 50_000]) for a in range(0, n, 50_000)]) if n else np.empty((0, k))
    order = np.lexsort((v, run))
    x, y, own = v[order], w[order], run[order]
    best = np.full((n, k), np.inf)
    for side in (-1, 1):
        live, step = np.arange(n), 0
        while len(live):
            step += side
            p = live + step
            inside = (p >= 0) & (p < n)
            live, p = live[inside], p[inside]
            far = np.abs(x[p] - x[live])
            near = (own[p] == own[live]) & (far <= best[live, -1])
            live, p, far = live[near], p[near], far[near]
            d = np.maximum(far, np.abs(y[p] - y[live]))
            better = d < best[live, -1]
            rows = live[better]
            best[rows, -1] = d[better]
            best[rows] = np.sort(best[rows], axis=1)
    out = np.empty((n, k))
    out[order] = best
    edge = np.flatnonzero(gap)
    before, after = np.concatenate([[-np.inf], w[edge]]), np.concatenate([w[edge + 1], [np.inf]])  # the ends of the runs beside
    open_ = np.flatnonzero(out[:, -1] >= np.minimum(w - before[run], after[run] - w))
    for a in range(0, len(open_), 50_000):
        at = open_[a : a + 50_000]
        out[at] = nearest_in(v, w, v[at], w[at], at, k, out[at, -1])
    return out


def _alone(t: pa.Table, k: int, cuts: np.ndarray) -> pa.Table:
    """Each row of a stripe with its k-th least distance within it and the stripes that it may reach; where these are others too, with all k."""
    t = t.sort_by("w")
    v = t.column("v").to_numpy()
    best = nearest_of_all(v, t.column("w").to_numpy(), k)
    r = best[:, -1]
    low, high = (np.searchsorted(cuts, x).astype(np.int32) for x in (v - np.minimum(r, 1e300), v + np.minimum(r, 1e300)))
    away = low < high
    ends = pa.array(np.concatenate([[0], np.cumsum(np.where(away, k, 0))]).astype(np.int32))
    d = pa.ListArray.from_arrays(ends, pa.array(best[away].ravel()))
    return pa.table({**{c: t.column(c) for c in ("id", "v", "w", "stripe")}, "d": d, "r": pa.array(r), "low": pa.array(low), "high": pa.array(high)})


def _visits(rows: pa.Table, visitors: pa.Table, k: int) -> pa.Table:
    rows = rows.sort_by("w")
    if len(rows) and len(visitors):
        v, w, qv, qw, bound = rows.column("v").to_numpy(), rows.column("w").to_numpy(), *(visitors.column(c).to_numpy() for c in ("v", "w", "r"))
        best = nearest_in(v, w, qv, qw, np.full(len(qv), -1), k, bound)
    else:
        best = np.full((len(visitors), k), np.inf)
    return pa.table({"id": visitors.column("id"), "v": visitors.column("v"), "w": visitors.column("w"), "d": pa.FixedSizeListArray.from_arrays(pa.array(best.ravel()), k).cast(pa.list_(pa.float64()))})


def _edges(away: DataFrame, stripes: int) -> tuple[np.ndarray, np.ndarray]:
    """How far into each stripe visitors from below and from above may reach: two numbers a stripe."""
    up, down = F.expr("v + r * 1.000001 + abs(v) * 1e-12"), F.expr("v - r * 1.000001 - abs(v) * 1e-12")
    got = away.groupBy("stripe").agg(F.max(F.when(F.col("own") < F.col("stripe"), up)).alias("up"), F.min(F.when(F.col("own") > F.col("stripe"), down)).alias("down")).collect()
    ups, downs = np.full(stripes, -np.inf), np.full(stripes, np.inf)
    for g in got:
        ups[g["stripe"]], downs[g["stripe"]] = -np.inf if g["up"] is None else g["up"], np.inf if g["down"] is None else g["down"]
    return ups, downs


def radii(rows: DataFrame, k: int, n: int, across: int = ACROSS) -> DataFrame:
    """rows (id, v, w) with r, the distance to the k-th neighbour. Only rows that may reach another stripe visit it, and of its rows they meet those within their reach."""
    cuts = _cuts(rows, "v", min(int(np.ceil(np.sqrt(n / across))), max(1, n // (4 * (k + 1)))))
    place, held = _place(cuts), np.array(cuts)
    striped = rows.withColumn("stripe", place("v"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, v double, w double"
    alone = settled(striped.groupBy("stripe").applyInArrow(lambda t: _alone(t, k, held), f"{kind}, stripe int, d array<double>, r double, low int, high int"), "alone")
    open_ = alone.filter("low < high")
    others = F.filter(F.sequence("low", "high"), lambda s: s != F.col("stripe"))
    away = open_.select("id", "v", "w", "r", F.col("stripe").alias("own"), F.explode(others).alias("stripe"))
    ups, downs = _edges(away, len(cuts) + 1)

    def reached(batches):
        for b in batches:
            v, at = b.column("v").to_numpy(), b.column("stripe").to_numpy()
            yield b.filter(pa.array((v <= ups[at]) | (v >= downs[at])))

    edge = alone.select("v", "w", "stripe").mapInArrow(reached, "v double, w double, stripe int")
    met = edge.groupBy("stripe").cogroup(away.drop("own").groupBy("stripe")).applyInArrow(lambda a, b: _visits(a, b, k), f"{kind}, d array<double>")
    all_ = open_.select("id", "v", "w", "d").unionByName(met)
    nearest = all_.groupBy("id").agg(F.first("v").alias("v"), F.first("w").alias("w"), F.element_at(F.array_sort(F.flatten(F.collect_list("d"))), k).alias("r"))
    return alone.filter("low >= high").select("id", "v", "w", "r").unionByName(nearest)


def counted(found: DataFrame, c: str, n: int) -> DataFrame:
    """id, n: the other rows nearer than r along the axis c. Within a range of sorted values rows are counted by place; the ends of those that reach beyond their range are dealt to the ranges that hold them."""
    cuts = np.array(_cuts(found, c, max(1, -(-n // RANGE))))
    kind = found.schema["id"].dataType.simpleString()

    def dealt(batches):
        for b in batches:
            at, r = b.column(c).to_numpy(zero_copy_only=False), b.column("r").to_numpy(zero_copy_only=False)
            # a little nearer than r, or the k-th neighbour itself would count where the ends are rounded
            less = np.maximum(0.0, r - np.maximum(r * 1e-9, np.abs(at) * 1e-15))
            part, low, high = (np.searchsorted(cuts, x).astype(np.int32) for x in (at, at - less, at + less))
            whole = (low == part) & (high == part)
            out = np.flatnonzero(~whole)
            names = b.column("id")
            yield pa.RecordBatch.from_arrays([pa.array(part), names, pa.array(at), pa.array(np.where(whole, less, np.nan)), pa.array(np.zeros(len(at), np.int8))], ["part", "id", "at", "less", "sign"])
            for sign, side, place in ((1, at + less, high), (-1, at - less, low)):
                yield pa.RecordBatch.from_arrays([pa.array(place[out]), names.take(pa.array(out)), pa.array(side[out]), pa.array(np.full(len(out), np.nan)), pa.array(np.full(len(out), sign, np.int8))], ["part", "id", "at", "less", "sign"])

    def counts(t: pa.Table) -> pa.Table:
        at, less, sign = (t.column(x).to_numpy() for x in ("at", "less", "sign"))
        value = sign == 0
        sorted_ = np.sort(at[value])
        whole = np.flatnonzero(~np.isnan(less))
        ends = np.flatnonzero(~value)
        inside = np.searchsorted(sorted_, at[whole] + less[whole]) - np.searchsorted(sorted_, at[whole] - less[whole], "right") - 1
        run = np.where(sign[ends] > 0, np.searchsorted(sorted_, at[ends]), np.searchsorted(sorted_, at[ends], "right"))
        names = pa.concat_arrays([t.column("id").combine_chunks().take(pa.array(np.concatenate([whole, ends]))), pa.nulls(1, t.column("id").type)])
        n = np.concatenate([np.maximum(inside, 0), run, [len(sorted_)]]).astype(np.int64)
        return pa.table({"id": names, "part": pa.array(np.full(len(n), t.column("part")[0].as_py(), np.int32)), "sign": pa.array(np.concatenate([np.zeros(len(whole)), sign[ends], [2]]).astype(np.int8)), "n": pa.array(n)})

    rows = found.select("id", c, "r").mapInArrow(dealt, f"part int, id {kind}, at double, less double, sign byte")
    rows = settled(rows.groupBy("part").applyInArrow(counts, f"id {kind}, part int, sign byte, n long"), "counts")
    sizes = np.zeros(len(cuts) + 1, np.int64)
    for g in rows.filter("sign = 2").select("part", "n").collect():  # a row a range
        sizes[g["part"]] = g["n"]
    starts = F.get(F.array(*[F.lit(int(x)) for x in np.cumsum(sizes) - sizes]).cast("array<bigint>"), F.col("part"))
    across = rows.filter("abs(sign) = 1").groupBy("id").agg(F.greatest(F.lit(0), F.sum(F.col("sign") * (F.col("n") + starts)) - 1).cast("long").alias("n"))
    return rows.filter("sign = 0").select("id", "n").unionByName(across)


def within(found: DataFrame, n: int) -> DataFrame:
    """found (id, v, w, r) with nv and nw: the other rows nearer than r along v and along w."""
    return counted(found, "v", n).withColumnRenamed("n", "nv").join(counted(found, "w", n).withColumnRenamed("n", "nw"), "id")


def mutual_information(df: DataFrame, x: str, y: str, ids: list[str], k: int = 3, seed: int = 0, across: int = ACROSS) -> float:
    """Nats, not below 0. ids name a row; rows that share an id get the same noise and count once."""
    id_ = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ids])
    known = df.select(id_.alias("id"), *[F.col(c).cast("double").alias(a) for c, a in ((x, "v"), (y, "w"))]).filter("v is not null and w is not null and not isnan(v) and not isnan(w)").dropDuplicates(["id"])
    known = settled(known, "known")
    s = known.agg(F.count("*").alias("n"), *[f(a).alias(f"{a}{i}") for a in ("v", "w") for i, f in enumerate((F.stddev_pop, lambda c: F.avg(F.abs(c)), F.approx_count_distinct))]).first().asDict()
    if s["n"] < k + 2 or not s["v0"] or not s["w0"]:
        return 0.0
    if s["v2"] < s["w2"]:
        known = known.select("id", F.col("w").alias("v"), F.col("v").alias("w"))
        s |= {f"{a}{i}": s[f"{b}{i}"] for a, b in (("v", "w"), ("w", "v")) for i in range(3)}
    noisy = {a: F.col(a) / s[f"{a}0"] + 1e-10 * max(1.0, s[f"{a}1"] / s[f"{a}0"]) * normal(seed, "noise", a, F.col("id")) for a in ("v", "w")}
    points = settled(known.withColumns(noisy).withColumn("id", F.monotonically_increasing_id()), "points")
    dropped(known)
    found = settled(radii(points, k, s["n"], across), "radii")
    dropped(points)
    whole = F.sum(F.round(digamma(F.col("n") + 1) * 1e12).cast("decimal(18,0)"))  # the same in any order
    mean = sum(float(counted(found, c, s["n"]).agg(whole.alias("m")).first()["m"]) for c in ("v", "w")) / 1e12 / s["n"]
    dropped(found)
    psi = lambda m: float(np.log(m) - 1 / (2 * m) - 1 / (12 * m**2)) if m > 20 else -0.5772156649015329 + sum(1 / j for j in range(1, m))
    return max(0.0, psi(s["n"]) + psi(k) - mean)


def mutual_information_select(df: DataFrame, features: list[str], target: str, ids: list[str], percent: float, k: int = 3) -> list[tuple[str, float]]:
    """The features of the highest scores, max(1, percent of all) of them, each scored alone; rows whose features are all zero are left out."""
    rows = df.filter(sum(F.coalesce((F.col(c) != 0).cast("int"), F.lit(0)) for c in features) > 0)
    scores = sorted(((c, mutual_information(rows, c, target, ids, k)) for c in features), key=lambda s: (-s[1], s[0]))
    return scores[: max(1, int(percent * len(features) / 100))]
