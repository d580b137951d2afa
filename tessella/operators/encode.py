"""Encodings and closed-form fits that take columns as arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec
from .settle import settled


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the place of the column's value among the sorted distinct ones, from 0; null stays null. Distinct values are sorted into ranges of themselves, whatever they begin with, and numbered through the ranges' counts, so neither a task nor the driver holds them all."""
    distinct = df.select(F.col(column).alias("__v")).distinct().filter("__v is not null")
    lined = settled(distinct.repartitionByRange("__v").sortWithinPartitions("__v").withColumn("__at", F.monotonically_increasing_id()), "distinct")
    lined = lined.withColumn("__p", F.shiftright("__at", 33))
    ranges = lined.groupBy("__p").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # a row a range
    ranges = ranges.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n") - F.col("__first")).alias("__shift"))
    codes = lined.join(F.broadcast(ranges), "__p").select("__v", (F.col("__at") + F.col("__shift")).cast("bigint").alias(name))
    return df.join(codes, F.col(column) == F.col("__v"), "left").drop("__v")


def dms_to_deg(text: Column) -> Column:
    """Degrees from "degrees minutes seconds"; the sign is the text's, so -0 counts; other forms give null."""
    p = F.split(F.trim(text), r"\s+")
    size = F.abs(p[0].try_cast("double")) + p[1].try_cast("double") / 60 + p[2].try_cast("double") / 3600
    return F.when(F.size(p) == 3, F.when(p[0].contains("-"), -size).otherwise(size))


def hms_to_deg(text: Column) -> Column:
    """Degrees from "hours minutes seconds"."""
    p = F.split(F.trim(text), r"\s+")
    return F.when(F.size(p) == 3, F.lit(15.0) * (p[0].try_cast("double") + p[1].try_cast("double") / 60 + p[2].try_cast("double") / 3600))


def coded(column: Column, codes: dict, other=None) -> Column:
    """The value a small map gives, else `other`."""
    pairs = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    found = F.try_element_at(pairs, column)
    return found if other is None else F.coalesce(found, F.lit(other))


def plane(df: DataFrame, keys: list[str], y: str, p: str, q: str) -> DataFrame:
    """Per key the least-squares plane y = intercept + first * p + second * q; null where p and q tell the same."""
    yp, yq, pq, pp, qq = F.covar_pop(y, p), F.covar_pop(y, q), F.covar_pop(p, q), F.var_pop(p), F.var_pop(q)
    sums = df.groupBy(*keys).agg(yp.alias("yp"), yq.alias("yq"), pq.alias("pq"), pp.alias("pp"), qq.alias("qq"), F.avg(y).alias("my"), F.avg(p).alias("mp"), F.avg(q).alias("mq"))
    det = F.expr("pp * qq - pq * pq")
    out = sums.withColumns({"first": F.try_divide(F.expr("yp * qq - yq * pq"), det), "second": F.try_divide(F.expr("yq * pp - yp * pq"), det)})
    return out.select(*keys, "first", "second", F.expr("my - first * mp - second * mq").alias("intercept"))


def time_features(ts: Column) -> dict[str, Column]:
    """Minute, hour, weekday from Monday 0, day, day of the year, month, week, by short name."""
    parts = (("mi", F.minute), ("h", F.hour), ("dow", F.weekday), ("d", F.dayofmonth), ("doy", F.dayofyear), ("mo", F.month), ("wk", F.weekofyear))
    return {name: part(ts) for name, part in parts}


def angle_sincos(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def remaining_life(s: SeriesSpec, cycle: str) -> Column:
    """Cycles up to the last one of the series."""
    return F.max(cycle).over(s.whole()) - F.col(cycle)


def clip_sigma(s: SeriesSpec, value: str, times: float = 3.0) -> Column:
    """The value within so many population deviations of its series' mean."""
    mean, spread = F.avg(value).over(s.whole()), F.stddev_pop(value).over(s.whole())
    return F.least(F.greatest(F.col(value), mean - times * spread), mean + times * spread)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def to_numeric(text: Column) -> Column:
    """A double; null where the text is no number."""
    return text.try_cast("double")


def chronological_part(s: SeriesSpec, df: DataFrame, name: str = "part", tenths: tuple[int, int] = (6, 8)) -> DataFrame:
    """df with train, valid or test by position in its series, the borders in tenths."""
    a = s.numbered(df, "__rn").withColumn("__n", s.length())
    first, second = (F.floor(F.col("__n") * x / 10) for x in tenths)
    return a.withColumn(name, F.when(F.col("__rn") < first, "train").when(F.col("__rn") < second, "valid").otherwise("test")).drop("__rn", "__n")


def folds(s: SeriesSpec, df: DataFrame, k: int, name: str = "fold") -> DataFrame:
    """Rows of k folds of n // k consecutive rows of each series; the remainder is left out, and so are series of under k rows."""
    a = s.numbered(df, "__rn").withColumn("__size", F.floor(s.length() / k))
    return a.filter(F.col("__rn") < F.col("__size") * k).withColumn(name, F.floor(F.try_divide(F.col("__rn"), F.col("__size")))).drop("__rn", "__size")


def spikes_mad(df: DataFrame, keys: tuple[str, ...], value: str, limit: float = 3.0) -> DataFrame:
    """Rows whose distance from their key's median exceeds the limit in median absolute deviations (times 0.6745); keys whose deviation is 0 have none."""
    on = list(keys)
    with_median = df.join(df.groupBy(*on).agg(F.median(value).alias("__med")), on)
    mad = with_median.groupBy(*on).agg(F.median(F.abs(F.col(value) - F.col("__med"))).alias("__mad"))
    return with_median.join(mad, on).filter((F.col("__mad") > 0) & (F.abs(0.6745 * (F.col(value) - F.col("__med")) / F.col("__mad")) > limit)).drop("__med", "__mad")
