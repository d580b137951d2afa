"""Augmentations of panels: noise, warps, permutations, crops, masks and drifts that every run and partitioning repeats.

All randomness is hashed from the seed, the series, the channel and the position, so an augmentation is a set of column
expressions; only those that read other positions of a series (warps of the clock, crops, permutations) meet the
series once more, by an equality join on key and position, which no long series makes a group of. A `panel` holds a
series' keys, its position `pos` from 0, its length `n` and the channels; every function takes and returns one.
Null values stay null and are copied or interpolated to null; a series of one row is its own warp.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec

KINDS = ("jitter", "scaling", "masking", "cropping", "time_warp")


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    spec: SeriesSpec
    channels: tuple[str, ...]
    places: SeriesSpec = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "places", SeriesSpec(self.spec.keys, ("pos",)))

    def but(self, **values: Column) -> Panel:
        return Panel(self.df.withColumns(values), self.spec, self.channels)

    def each(self, f) -> Panel:
        """f(channel name, its value) in place of every channel."""
        return self.but(**{c: f(c, F.col(c)) for c in self.channels})


def panel(df: DataFrame, spec: SeriesSpec, channels: tuple[str, ...]) -> Panel:
    rows = spec.numbered(df, "pos").withColumn("n", spec.length())
    return Panel(rows.select(*spec.keys, "pos", "n", *[F.col(c).cast("double").alias(c) for c in channels]), spec, channels)


def draw(seed: int, *parts) -> Column:
    """A number in [0, 1) from the seed and the parts (columns, or texts as they are): 48 bits of an MD5."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(seed: int, *parts) -> Column:
    """A standard normal number, by two draws."""
    return F.sqrt(-2 * F.log(1 - draw(seed, *parts, "r"))) * F.cos(2 * pi * draw(seed, *parts, "a"))


def _keys(p: Panel) -> list[Column]:
    return [F.col(k) for k in p.spec.keys]


def jitter(p: Panel, scale: float, seed: int) -> Panel:
    """Every value plus normal noise."""
    return p.each(lambda c, x: x + scale * normal(seed, "jitter", *_keys(p), F.col("pos"), c))


def scaling(p: Panel, scale: float, seed: int) -> Panel:
    """A series' channel times one normal factor about 1."""
    return p.each(lambda c, x: x * (1 + scale * normal(seed, "scaling", *_keys(p), c)))


def curve(p: Panel, scale: float, seed: int, knots: int, *tag) -> Column:
    """A smooth curve about 1 over the positions: a Catmull-Rom cubic through knots + 2 evenly spaced normal heights. No knot is stored, each row draws the four it lies between."""
    u = F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(F.lit(0.0)) * (knots + 1)
    i = F.least(F.floor(u), F.lit(knots)).cast("long")
    t = u - i
    a, b, c, d = (1 + scale * normal(seed, *tag, *_keys(p), F.greatest(F.lit(0), F.least(i + k, F.lit(knots + 1)))) for k in (-1, 0, 1, 2))
    return b + 0.5 * t * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a)))


def magnitude_warp(p: Panel, scale: float, seed: int, knots: int = 0) -> Panel:
    """All of a series times one uniform factor within scale of 1; with knots, a channel times a smooth curve of its own."""
    if knots:
        return p.each(lambda c, x: x * curve(p, scale, seed, knots, "mag_warp", c))
    factor = 1 - scale + 2 * scale * draw(seed, "mag_warp", *_keys(p))
    return p.each(lambda c, x: x * factor)


def resample(p: Panel, at: Column) -> Panel:
    """Every row gets the values at the fractional position `at` of its series, linear between neighbours."""
    keys = list(p.spec.keys)
    held = p.df.withColumn("__at", F.greatest(F.lit(0.0), F.least(at, (F.col("n") - 1).cast("double")))).withColumn("__f", F.floor("__at"))
    here = held.select(*[c for c in held.columns if c not in p.channels])
    values = p.df.select(*keys, F.col("pos").alias("__f"), *[F.struct(F.col(c).alias("a"), F.lead(c).over(p.places.window()).alias("b")).alias(c) for c in p.channels])
    t = F.col("__at") - F.col("__f")
    met = here.join(values, [*keys, "__f"])
    out = met.withColumns({c: F.when(t == 0, F.col(c)["a"]).otherwise(F.col(c)["a"] + t * (F.col(c)["b"] - F.col(c)["a"])) for c in p.channels})
    return Panel(out.drop("__f", "__at"), p.spec, p.channels)


def _warped(p: Panel, scale: float, seed: int) -> Column:
    """Positions of a clock with normal noise at each tick, within the series."""
    unit = F.when(F.col("n") > 1, 2 * F.col("pos") / (F.col("n") - 1) - 1).otherwise(F.lit(-1.0)) + scale * normal(seed, "time_warp", *_keys(p), F.col("pos"))
    return (F.greatest(F.lit(-1.0), F.least(unit, F.lit(1.0))) + 1) / 2 * (F.col("n") - 1)


def time_warp(p: Panel, scale: float, seed: int, knots: int = 0) -> Panel:
    """The series read off by another clock: noise at each tick; with knots, a clock whose speed is a smooth curve, so that it never goes back and both ends stay."""
    if not knots:
        return resample(p, _warped(p, scale, seed))
    speed = F.greatest(curve(p, scale, seed, knots, "time_warp"), F.lit(0.05))
    quick = p.but(__s=F.when(F.col("pos") > 0, speed).otherwise(F.lit(0.0)))
    run = p.places.window().rowsBetween(Window.unboundedPreceding, 0)
    timed = quick.but(__t=F.sum("__s").over(run), __all=F.sum("__s").over(p.places.whole()))
    out = resample(timed, F.when(F.col("__all") > 0, F.col("__t") / F.col("__all") * (F.col("n") - 1)).otherwise(F.lit(0.0)))
    return Panel(out.df.drop("__s", "__t", "__all"), p.spec, p.channels)


def permutation(p: Panel, seed: int, least: int = 2, most: int = 4) -> Panel:
    """A series cut into least to most near-equal pieces in a drawn order; rows get the positions they move to."""
    parts = (least + F.floor(draw(seed, "pieces", *_keys(p)) * (most - least + 1))).cast("int")
    start = lambda k: F.floor(k * F.col("n") / F.col("__parts")).cast("long")
    own = F.col("__own")
    rank = lambda k: F.when(k < F.col("__parts"), draw(seed, "order", *_keys(p), k))
    moved = F.lit(0).cast("long")
    for k in range(most):
        k = F.lit(k)
        ahead = (rank(k) < F.col("__rank")) | ((rank(k) == F.col("__rank")) & (k < own))
        moved = moved + F.when((k < F.col("__parts")) & ahead, start(k + 1) - start(k)).otherwise(F.lit(0))
    held = p.but(__parts=parts)
    # the last piece that begins at or before the row
    piece = F.lit(0)
    for k in range(1, most):
        piece = F.when((F.lit(k) < F.col("__parts")) & (start(F.lit(k)) <= F.col("pos")), F.lit(k)).otherwise(piece)
    held = held.but(__own=piece).but(__rank=draw(seed, "order", *_keys(p), own)).but(pos=moved + F.col("pos") - start(own))
    return Panel(held.df.drop("__parts", "__own", "__rank"), p.spec, p.channels)


def cropping(p: Panel, scale: float, seed: int, stretch: bool = False) -> Panel:
    """A drawn stretch of 1 - scale of each series, moved to its start with zeros behind, or (stretch) interpolated to the old length."""
    keep, start = _crop(p, scale, seed)
    if stretch:
        return resample(p, _stretched(keep, start))
    held = p.but(__keep=keep, __start=start)
    keys = list(p.spec.keys)
    values = held.df.select(*keys, (F.col("pos") - F.col("__start")).alias("pos"), *p.channels).filter("pos >= 0")
    out = held.df.select(*keys, "pos", "n", "__keep").join(values, [*keys, "pos"], "left")
    return Panel(out.withColumns({c: F.when(F.col("pos") < F.col("__keep"), F.col(c)).otherwise(F.lit(0.0)) for c in p.channels}).drop("__keep"), p.spec, p.channels)


def _crop(p: Panel, scale: float, seed: int) -> tuple[Column, Column]:
    keep = F.floor(F.col("n") * (1 - scale))
    return keep, F.floor(draw(seed, "cropping", *_keys(p)) * (F.col("n") - keep + 1))


def _stretched(keep: Column, start: Column) -> Column:
    return start + F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(F.lit(0.0)) * F.greatest(keep - 1, F.lit(0))


def masking(p: Panel, scale: float, seed: int) -> Panel:
    """A share of the values becomes zero."""
    return p.each(lambda c, x: F.when(draw(seed, "masking", *_keys(p), F.col("pos"), c) < scale, F.lit(0.0)).otherwise(x))


def drift(p: Panel, scale: float, sign: int) -> Panel:
    """Plus or minus a line from 0 to scale over each series."""
    rise = F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(F.lit(0.0)) * (scale * sign)
    return p.each(lambda c, x: x + rise)


def two_views(p: Panel, scale: float, seed: int) -> DataFrame:
    """Two views of each series by two different kinds of `KINDS` drawn for it: the panel's rows twice, with view (1, 2) and kind. Crops are stretched back. Both views read the series by one join."""
    first = F.floor(draw(seed, "view", *_keys(p)) * len(KINDS))
    second = (first + 1 + F.floor(draw(seed, "other", *_keys(p)) * (len(KINDS) - 1))) % len(KINDS)
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.when(F.col("view") == 1, first).otherwise(second).cast("int"))
    both = Panel(p.df.withColumn("view", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("kind", kind), p.spec, p.channels)
    is_ = lambda k: F.col("kind") == k
    at = F.when(is_("cropping"), _stretched(*_crop(p, scale, seed))).when(is_("time_warp"), _warped(p, scale, seed)).otherwise(F.col("pos").cast("double"))
    keys = list(p.spec.keys)
    read = both.df.select(*[c for c in both.df.columns if c not in p.channels], F.greatest(F.lit(0.0), F.least(at, (F.col("n") - 1).cast("double"))).alias("__at")).withColumn("__f", F.floor("__at"))
    values = p.df.select(*keys, F.col("pos").alias("__f"), *[F.struct(F.col(c).alias("a"), F.lead(c).over(p.places.window()).alias("b")).alias(c) for c in p.channels])
    t = F.col("__at") - F.col("__f")

    def seen(c: str) -> Column:
        x = F.when(t == 0, F.col(c)["a"]).otherwise(F.col(c)["a"] + t * (F.col(c)["b"] - F.col(c)["a"]))
        return (
            F.when(is_("jitter"), x + scale * normal(seed, "jitter", *_keys(p), F.col("pos"), c))
            .when(is_("scaling"), x * (1 + scale * normal(seed, "scaling", *_keys(p), c)))
            .when(is_("masking"), F.when(draw(seed, "masking", *_keys(p), F.col("pos"), c) < scale, F.lit(0.0)).otherwise(x))
            .otherwise(x)
        )

    out = read.join(values, [*keys, "__f"])
    return out.withColumns({c: seen(c) for c in p.channels}).drop("__at", "__f")
