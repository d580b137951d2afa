"""Global row positions and what rests on them, and draws by hash: repeatable on any partitioning."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, order: str, name: str = "pos", ranges: int = 64) -> tuple[DataFrame, int]:
    """df with its global position from 0 by a unique numeric order column, and the row count. Rows are numbered within value
    ranges whose bounds are approximate quantiles, so no task sorts everything; bounds and counts (`ranges` numbers) come to the driver."""
    at = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(order, at, 10_000).alias("b")).first()["b"]
    if found is None:
        return df.withColumn(name, F.lit(0).cast("bigint")), 0
    cuts = sorted(set(found))
    place = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order)))
    counts = {r["__r"]: r["count"] for r in df.groupBy(place.alias("__r")).count().collect()}
    before = list(accumulate((counts.get(k, 0) for k in range(len(cuts) + 1)), initial=0))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy(order)) - 1
    out = df.withColumn("__r", place).withColumn(name, (inside + F.get(F.array(*[F.lit(b) for b in before]), F.col("__r"))).cast("bigint"))
    return out.drop("__r"), before[-1]


def tile(pos: Column, n: int, parts: int) -> Column:
    """The part (from 0) of near-equal parts, the remainder over the first ones."""
    q, r = divmod(n, parts)
    long = r * (q + 1)
    if not q:
        return pos.cast("int")
    return F.when(pos < long, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - long) / q)).cast("int")


def weighted_tile(pos: Column, n: int, weights: list[float]) -> Column:
    """The part of ranges whose ends are the rounded cumulative weights' shares of n."""
    total, run, out = sum(weights), 0.0, F.lit(0)
    for w in weights[:-1]:
        run += w
        out = out + (pos >= int(round(n * run / total))).cast("int")
    return out


def share(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only: 48 bits of the MD5 of their texts, the same on every engine."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("double") / float(1 << 48)


def values_ranked(df: DataFrame, column: str, ranges: int = 64, weight: str | None = None) -> DataFrame:
    """column, n (its rows, or the sum of their weights), before (rows with a smaller value): one row a distinct value. Values are counted first, then summed up within ranges, so no task sorts all rows; nulls are left out."""
    known = df.filter(F.col(column).isNotNull())
    at = known.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10_000).alias("b")).first()["b"] or []
    place = F.array_size(F.filter(F.array(*[F.lit(c) for c in sorted(set(at))]), lambda c: c < F.col(column))) if at else F.lit(0)
    counted = known.groupBy(column).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).withColumn("__r", place)
    sizes = counted.groupBy("__r").agg(F.sum("n").alias("__n"))  # a row a range
    starts = sizes.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__s"))
    inside = F.sum("n").over(Window.partitionBy("__r").orderBy(column)) - F.col("n")
    return counted.withColumn("__i", inside).join(starts, "__r").select(column, "n", (F.col("__i") + F.col("__s")).cast("bigint").alias("before"))


def average_ranks(df: DataFrame, column: str, name: str, weight: str | None = None) -> DataFrame:
    """df with the rank of the column's value from 1, ties their average; null for null. A row stands for as many as its weight says."""
    ranks = values_ranked(df, column, weight=weight).select(F.col(column).alias("__v"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact quantile, linear between neighbours: two rows of the ranked values come to the driver."""
    ranked = values_ranked(df, column)
    n = ranked.agg(F.sum("n").alias("n")).first()["n"]
    if not n:
        return None
    place = q * (n - 1)
    low = int(place)
    got = ranked.filter((F.col("before") <= min(low + 1, n - 1)) & (F.col("before") + F.col("n") > low)).orderBy("before").select(column, "before", "n").collect()
    at = lambda k: next(r[0] for r in got if r["before"] <= k < r["before"] + r["n"])
    a, b = float(at(low)), float(at(min(low + 1, n - 1)))
    return a + (place - low) * (b - a)


def sample_fraction(df: DataFrame, fraction: float, seed: int, *ids: str) -> DataFrame:
    return df.filter(share(seed, *ids) < fraction)


def bootstrap(df: DataFrame, order: str, fraction: float, seed: int) -> DataFrame:
    """int(n * fraction) draws with replacement, as column draw: hashed positions joined on positions."""
    rows, n = positions(df, order)
    draws = df.sparkSession.range(int(n * fraction)).select(F.col("id").alias("draw"), F.floor(share(seed, "id") * n).cast("bigint").alias("pos"))
    return draws.join(rows, "pos").drop("pos")


def dropout(df: DataFrame, value: str, fraction: float, seed: int, *ids: str) -> DataFrame:
    """A share of the values becomes null."""
    return df.withColumn(value, F.when(share(seed, *ids) >= fraction, F.col(value)))
