"""Order-dependent operators on panels in long form. Each takes a DataFrame and a SeriesSpec and only builds a plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec


def fold_tumbling(df: DataFrame, s: SeriesSpec, w: int, value: str) -> DataFrame:
    """Full windows of w rows: win, mean and last value. A remainder is dropped."""
    at = s.numbered(df).withColumn("win", F.floor(F.col("rn") / w))
    out = at.groupBy(*s.keys, "win").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max_by(value, "rn").alias("last"))
    return out.filter(F.col("n") == w).drop("n")


def sliding(df: DataFrame, s: SeriesSpec, w: int, stride: int, horizon: int, value: str) -> DataFrame:
    """Windows starting at 0, stride, ... while start <= n - w - horizon. Starts are filtered before arrays reach anything else."""
    at = s.numbered(df).withColumn("n", s.length()).withColumn("x", F.collect_list(value).over(s.rows(0, w - 1)))
    for h in range(1, horizon + 1):
        at = at.withColumn(f"y{h}", F.lead(value, w + h - 1).over(s.window()))
    return at.filter((F.col("rn") % stride == 0) & (F.col("rn") <= F.col("n") - w - horizon))


def tail(df: DataFrame, s: SeriesSpec, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(s.reverse())).filter(F.col("__r") <= n).drop("__r")


def stride(df: DataFrame, s: SeriesSpec, n: int) -> DataFrame:
    """Every n-th row from the first."""
    if n <= 0:
        raise ValueError("n must be positive")
    return s.numbered(df, "__r").filter(F.col("__r") % n == 0).drop("__r")


def head(df: DataFrame, s: SeriesSpec, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    return s.numbered(df, "__r").filter(F.col("__r") < n).drop("__r")


def rolling_mean(df: DataFrame, s: SeriesSpec, n: int, value: str, out: str, lag: int = 0) -> DataFrame:
    """Trailing mean of n rows ending `lag` rows back; null until n rows are there."""
    w = s.rows(-(n - 1) - lag, -lag)
    return df.withColumn(out, F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def expanding(df: DataFrame, s: SeriesSpec, value: str, least: int) -> DataFrame:
    w = s.rows(Window.unboundedPreceding, 0)
    enough = F.count(value).over(w) >= least
    return df.withColumns({"ex_mean": F.when(enough, F.avg(value).over(w)), "ex_std": F.when(enough, F.stddev_pop(value).over(w))})


def fill_linear(df: DataFrame, s: SeriesSpec, value: str, out: str) -> DataFrame:
    """Linear by position; edges take the nearest value."""
    at = s.numbered(df, "__r")
    back, ahead = s.rows(Window.unboundedPreceding, 0), s.rows(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col("__r"))
    at = at.withColumns({"__pv": F.last(value, True).over(back), "__pr": F.last(known, True).over(back), "__nv": F.first(value, True).over(ahead), "__nr": F.first(known, True).over(ahead)})
    slope = (F.col("__nv") - F.col("__pv")) * (F.col("__r") - F.col("__pr")) / (F.col("__nr") - F.col("__pr"))
    return at.withColumn(out, F.coalesce(F.col(value), F.col("__pv") + slope, F.col("__pv"), F.col("__nv"))).drop("__r", "__pv", "__pr", "__nv", "__nr")


def fill_backward_forward(df: DataFrame, s: SeriesSpec, value: str, out: str) -> DataFrame:
    back, ahead = s.rows(Window.unboundedPreceding, 0), s.rows(0, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.first(value, True).over(ahead), F.last(value, True).over(back)))


def acf(df: DataFrame, s: SeriesSpec, value: str, lags: list[int]) -> DataFrame:
    """sum(x_t x_{t+k}) / sum(x^2) on the centred series, a row for each key and lag."""
    centred = df.withColumn("__x", F.col(value) - F.avg(value).over(s.whole()))
    led = centred.withColumns({f"__l{k}": F.lead("__x", k).over(s.window()) for k in lags})
    sums = led.groupBy(*s.keys).agg(F.sum(F.col("__x") * F.col("__x")).alias("__d"), *[F.sum(F.col("__x") * F.col(f"__l{k}")).alias(f"__s{k}") for k in lags])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"__s{k}") / F.col("__d")).alias("acf")) for k in lags]))
    return sums.select(*s.keys, pairs.alias("__p")).select(*s.keys, "__p.lag", "__p.acf")


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a key differs from the row before (nulls are one key), from the first one on."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        c = t.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(new) + 1) if t.num_rows else np.zeros(0, int)


def each_series(df: DataFrame, s: SeriesSpec, columns: list[str], f, out: str) -> DataFrame:
    """keys and the rows that f makes of each series' sorted columns (name -> numpy array, as its result): one exchange and one sort by key and order, then series are cut from the batches where the key changes.
    A series must fit a task's memory, a partition needn't. A key named like a column of the result gives way to it."""
    names = [c.split()[0] for c in out.split(", ")]
    keys = [k for k in s.keys if k not in names]
    kinds = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [out])

    def run(batches):
        held, parts, size = None, [], 0

        def made(t: pa.Table) -> None:
            nonlocal size
            got = f({c: t.column(c).to_numpy() for c in columns})
            n = len(got[names[0]])
            if n:
                parts.append([pa.repeat(t.column(k)[0], n) for k in keys] + [pa.array(got[c]) for c in names])
                size += n

        def flushed():
            nonlocal parts, size
            if parts:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], [*keys, *names])
            parts, size = [], 0

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            starts = _starts(t, list(s.keys))
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                made(t.slice(a, z - a))
                if size > 50_000:
                    yield from flushed()
            held = t.slice(starts[-1]) if len(starts) else held
        if held is not None and held.num_rows:
            made(held)
        yield from flushed()

    rows = df.select(*dict.fromkeys([*s.keys, *s.order, *columns]))
    dealt = rows.repartition(*s.keys) if s.keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*s.keys, *s.order).select(*dict.fromkeys([*s.keys, *columns])).mapInArrow(run, kinds)


def spectrum(df: DataFrame, s: SeriesSpec, value: str, centre: bool = True) -> DataFrame:
    """Power of the real Fourier transform by bin k = 1..n/2 (k = 1 for a single row): one fast transform a series, which must fit a task's memory. Nulls count as 0 behind the centring.
    A key named like a column of the result gives way to it."""
    def run(column: dict) -> dict:
        y = column[value].astype(float)
        x = np.nan_to_num(y - (np.nanmean(y) if centre and not np.isnan(y).all() else 0.0))
        f = np.fft.rfft(x)[1 : max(2, len(x) // 2 + 1)] if len(x) > 1 else np.array([x.sum()])
        return {"k": np.arange(1, len(f) + 1, dtype=np.int32), "n": np.full(len(f), len(x), np.int64), "re": f.real, "im": -f.imag, "power": np.abs(f) ** 2}

    return each_series(df, s, [value], run, "k int, n long, re double, im double, power double")


def triangle_areas(df: DataFrame, s: SeriesSpec, x: str, y: str) -> DataFrame:
    """Area of each row's triangle with its neighbours, once; end points infinite."""
    px, py, nx, ny = (f(c, 1).over(s.window()) for f in (F.lag, F.lead) for c in (x, y))
    area = F.abs((F.col(x) - px) * (ny - py) - (nx - px) * (F.col(y) - py)) / 2
    return df.withColumn("area", F.coalesce(area, F.lit(float("inf"))))


def alarm_suppress(df: DataFrame, s: SeriesSpec, alarm: str, delay: int) -> DataFrame:
    """Keep an alarm unless a kept one lies within the `delay` rows before; the first `delay` rows are exempt. One pass over each series' sorted alarm positions, with only the last kept one in mind."""
    def run(column: dict) -> dict:
        kept, last = [], None
        for p in np.flatnonzero(column[alarm] == True).tolist():  # noqa: E712  nulls aren't alarms
            if p < delay or last is None or p - last > delay:
                kept.append(p)
                last = p
        return {"rn": np.array(kept, np.int64)}

    return each_series(df, s, [alarm], run, "rn long")


def pad_nan(values: Column, length: int, both_sides: bool = False) -> Column:
    """An array with NaN behind it up to the length (half of them, rounded down, before it with both_sides); longer ones stay."""
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    before = F.floor(missing / 2).cast("int") if both_sides else F.lit(0)
    nan = F.lit(float("nan"))
    return F.concat(F.array_repeat(nan, before), values, F.array_repeat(nan, missing - before))


def split_with_nan(values: Column, sections: int) -> Column:
    """Arrays of near-equal length, the longer ones first; shorter ones end with NaN so that all are as long as the first."""
    n = F.size(values)
    first = F.ceil(n / sections).cast("int")
    size = lambda k: (F.floor(n / sections) + (F.lit(k) < n % sections).cast("int")).cast("int")
    start = lambda k: (F.floor(n / sections) * k + F.least(F.lit(k), n % sections)).cast("int")
    cut = [F.slice(values, start(k) + 1, size(k)) for k in range(sections)]
    return F.array(*[F.concat(c, F.array_repeat(F.lit(float("nan")), first - F.size(c))) for c in cut])


def centre_series(values: Column) -> Column:
    """The array turned round so that the NaN (or null) runs before and behind its values are as long as each other, but for one; all NaN: unchanged."""
    there = F.transform(values, lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    n, prefix, suffix = F.size(values), F.array_position(there, F.lit(True)) - 1, F.array_position(F.reverse(there), F.lit(True)) - 1
    shift = F.floor((prefix + suffix) / 2) - prefix
    turned = F.transform(values, lambda _, i: F.get(values, F.pmod(i - shift, n).cast("int")))
    return F.when(prefix >= 0, turned).otherwise(values)


def recursive_forecast(df: DataFrame, s: SeriesSpec, value: str, steps: int) -> DataFrame:
    """Per series an autoregression of one lag, fitted by least squares, fed with its own output: step from 1, forecast. A series without a slope (constant, or under three rows) repeats its mean of the rows that follow another."""
    rows = df.withColumn("__x", F.lag(value).over(s.window()))
    fit = rows.groupBy(*s.keys).agg(F.regr_slope(value, "__x").alias("a"), F.regr_intercept(value, "__x").alias("b"), F.avg(F.when(F.col("__x").isNotNull(), F.col(value))).alias("m"), F.max_by(value, F.struct(*s.order)).alias("last"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", "m")
    said = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.col("last").cast("double")), lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) * a + b)))
    return fit.select(*s.keys, F.posexplode(said).alias("step", "forecast")).filter("step > 0")


def point_adjust(df: DataFrame, s: SeriesSpec, truth: str, predicted: str, delay: int) -> DataFrame:
    """A true segment counts as found, whole, if a prediction hits it within `delay` rows of its start; else as missed. Outside nothing changes."""
    changed = F.coalesce((F.col(truth) != F.lag(truth).over(s.window())).cast("int"), F.lit(1))
    at = df.withColumn("__seg", F.sum(changed).over(s.rows(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*s.keys, "__seg")
    at = at.withColumn("__at", F.row_number().over(inside.orderBy(*s.order)))
    hit = F.max(F.when(F.col("__at") <= delay + 1, F.col(predicted))).over(inside)
    return at.withColumn("adjusted", F.when(F.col(truth) == 1, hit).otherwise(F.col(predicted)).cast("int")).drop("__seg", "__at")
