"""Queries on augmentations of the events panel: a series a user, channels value and k (of the events' properties)."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment as A
from ..spec import SeriesSpec, r6
from .registry import query

EV = SeriesSpec(("user_id",), ("ts", "event_id"))
CHANNELS = ("value", "k")
PANEL = """p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)"""
OUT = "SELECT user_id, pos::BIGINT AS pos, round({value}, 6) AS value, round({k}, 6) AS k FROM "
SCALE = 0.1


def _panel(t) -> A.Panel:
    return A.panel(t.events.withColumn("k", F.get_json_object("props", "$.k").cast("double")), EV, CHANNELS)


def _said(p: A.Panel) -> DataFrame:
    return p.df.select("user_id", F.col("pos").cast("long").alias("pos"), *[r6(F.col(c)).alias(c) for c in CHANNELS])


def _draw(seed: int, *parts: str) -> str:
    said = f"concat_ws(':', '{seed}', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")"
    return f"(('0x' || substr(md5({said}), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)}::DOUBLE)"


def _normal(seed: int, *parts: str) -> str:
    return f"""(sqrt(-2 * ln(1 - {_draw(seed, *parts, "'r'")})) * cos({2 * pi!r}::DOUBLE * {_draw(seed, *parts, "'a'")}))"""


def _each(f) -> str:
    return OUT.format(**{c: f(c) for c in CHANNELS})


UNIT = "(CASE WHEN n > 1 THEN pos::DOUBLE / (n - 1) ELSE 0.0::DOUBLE END)"


def _curve(scale: float, seed: int, knots: int, *tag: str) -> str:
    u = f"({UNIT} * {knots + 1})"
    i = f"least(floor({u})::BIGINT, {knots})"
    a, b, c, d = (f"(1 + {scale}::DOUBLE * {_normal(seed, *tag, 'user_id', f'greatest(0, least({i} + {k}, {knots + 1}))')})" for k in (-1, 0, 1, 2))
    return f"(SELECT b + 0.5::DOUBLE * t * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a))) FROM (SELECT {u} - {i} AS t, {a} AS a, {b} AS b, {c} AS c, {d} AS d))"


#: The series at fractional positions: q(user_id, pos, n, spot, ...) read from p.
READ = """c AS (SELECT *, greatest(0.0::DOUBLE, least(spot, (n - 1)::DOUBLE)) AS w FROM q),
m AS (SELECT c.* EXCLUDE (value, k), w - floor(w) AS t, a.value AS value_a, b.value AS value_b, a.k AS k_a, b.k AS k_b FROM c JOIN p a ON a.user_id = c.user_id AND a.pos = floor(w) LEFT JOIN p b ON b.user_id = c.user_id AND b.pos = floor(w) + 1),
x AS (SELECT * EXCLUDE (value_a, value_b, k_a, k_b), CASE WHEN t = 0 THEN value_a ELSE value_a + t * (value_b - value_a) END AS value, CASE WHEN t = 0 THEN k_a ELSE k_a + t * (k_b - k_a) END AS k FROM m)"""
NOISY = f"((greatest(-1.0::DOUBLE, least(CASE WHEN n > 1 THEN 2 * pos::DOUBLE / (n - 1) - 1 ELSE -1.0::DOUBLE END + {SCALE}::DOUBLE * {_normal(14, repr('time_warp'), 'user_id', 'pos')}, 1.0::DOUBLE)) + 1) / 2 * (n - 1))"
KEEP = f"floor(n * (1 - {SCALE}::DOUBLE))"


def _start(seed: int) -> str:
    return f"floor({_draw(seed, repr('cropping'), 'user_id')} * (n - {KEEP} + 1))"


@query(f"WITH {PANEL} {_each(lambda c: f'{c} + {SCALE}::DOUBLE * ' + _normal(11, repr('jitter'), 'user_id', 'pos', repr(c)))} p")
def augment_jitter(t):
    return _said(A.jitter(_panel(t), SCALE, 11))


@query(f"WITH {PANEL} {_each(lambda c: f'{c} * (1 + {SCALE}::DOUBLE * ' + _normal(12, repr('scaling'), 'user_id', repr(c)) + ')')} p")
def augment_scaling(t):
    return _said(A.scaling(_panel(t), SCALE, 12))


@query(f"WITH {PANEL} {_each(lambda c: f'{c} * (1 - {SCALE}::DOUBLE + 2 * {SCALE}::DOUBLE * ' + _draw(13, repr('mag_warp'), 'user_id') + ')')} p")
def augment_mag_warp(t):
    return _said(A.magnitude_warp(_panel(t), SCALE, 13))


@query(f"WITH {PANEL} {_each(lambda c: f'{c} * ' + _curve(SCALE, 13, 4, repr('mag_warp'), repr(c)))} p")
def augment_mag_warp_smooth(t):
    return _said(A.magnitude_warp(_panel(t), SCALE, 13, knots=4))


@query(f"WITH {PANEL}, q AS (SELECT *, {NOISY} AS spot FROM p), {READ} {_each(lambda c: c)} x")
def augment_time_warp(t):
    return _said(A.time_warp(_panel(t), SCALE, 14))


@query(f"""WITH {PANEL}, s AS (SELECT *, CASE WHEN pos > 0 THEN greatest({_curve(0.5, 14, 3, repr('time_warp'))}, 0.05::DOUBLE) ELSE 0.0::DOUBLE END AS s FROM p),
q AS (SELECT * EXCLUDE (s), CASE WHEN sum(s) OVER u > 0 THEN sum(s) OVER (u ORDER BY pos) / sum(s) OVER u * (n - 1) ELSE 0.0::DOUBLE END AS spot FROM s WINDOW u AS (PARTITION BY user_id)), {READ} {_each(lambda c: c)} x""")
def augment_time_warp_smooth(t):
    return _said(A.time_warp(_panel(t), 0.5, 14, knots=3))


@query(f"""WITH {PANEL}, a AS (SELECT *, 2 + floor({_draw(15, repr('pieces'), 'user_id')} * 3)::BIGINT AS parts FROM p),
s AS (SELECT DISTINCT user_id, n, parts, i, floor(i * n / parts::DOUBLE)::BIGINT AS lo, floor((i + 1) * n / parts::DOUBLE)::BIGINT AS hi, {_draw(15, repr('order'), 'user_id', 'i')} AS r FROM a, range(4) x(i) WHERE i < parts),
o AS (SELECT user_id, lo, hi, sum(hi - lo) OVER (PARTITION BY user_id ORDER BY r, i) - (hi - lo) AS base FROM s)
SELECT a.user_id, (base + a.pos - lo)::BIGINT AS pos, value, k FROM a JOIN o ON a.user_id = o.user_id AND a.pos >= lo AND a.pos < hi""")
def augment_permutation(t):
    return _said(A.permutation(_panel(t), 15))


@query(f"""WITH {PANEL}, q AS (SELECT *, {KEEP} AS keep, {_start(16)} AS start FROM p)
SELECT a.user_id, a.pos::BIGINT AS pos, CASE WHEN a.pos < a.keep THEN b.value ELSE 0 END AS value, CASE WHEN a.pos < a.keep THEN b.k ELSE 0 END AS k FROM q a LEFT JOIN q b ON a.user_id = b.user_id AND b.pos = a.pos + a.start""")
def augment_cropping(t):
    return _said(A.cropping(_panel(t), SCALE, 16))


@query(f"WITH {PANEL} {_each(lambda c: f'CASE WHEN ' + _draw(17, repr('masking'), 'user_id', 'pos', repr(c)) + f' < {SCALE}::DOUBLE THEN 0.0 ELSE {c} END')} p")
def augment_masking(t):
    return _said(A.masking(_panel(t), SCALE, 17))


@query(f"WITH {PANEL} {_each(lambda c: f'{c} - {SCALE}::DOUBLE * {UNIT}')} p")
def augment_drift(t):
    return _said(A.drift(_panel(t), SCALE, -1))


def _views(seed: int) -> str:
    kinds = "[" + ", ".join(f"'{k}'" for k in A.KINDS) + "]"
    first = f"floor({_draw(seed, repr('view'), 'user_id')} * {len(A.KINDS)})"
    noisy = NOISY.replace("concat_ws(':', '14'", f"concat_ws(':', '{seed}'")
    stretched = f"({_start(seed)} + {UNIT} * greatest({KEEP} - 1, 0))"

    def seen(c: str) -> str:
        return (
            f"CASE kind WHEN 'jitter' THEN {c} + {SCALE}::DOUBLE * {_normal(seed, repr('jitter'), 'user_id', 'pos', repr(c))} WHEN 'scaling' THEN {c} * (1 + {SCALE}::DOUBLE * {_normal(seed, repr('scaling'), 'user_id', repr(c))}) "
            f"WHEN 'masking' THEN CASE WHEN {_draw(seed, repr('masking'), 'user_id', 'pos', repr(c))} < {SCALE}::DOUBLE THEN 0.0 ELSE {c} END ELSE {c} END"
        )

    return f"""WITH {PANEL}, v AS (SELECT *, {first} AS one, ({first} + 1 + floor({_draw(seed, repr('other'), 'user_id')} * {len(A.KINDS) - 1})) % {len(A.KINDS)} AS two FROM p),
b AS (SELECT v.* EXCLUDE (one, two), view, {kinds}[(CASE view WHEN 1 THEN one ELSE two END)::INT + 1] AS kind FROM v, (SELECT unnest([1, 2]) AS view)),
q AS (SELECT *, CASE kind WHEN 'cropping' THEN {stretched} WHEN 'time_warp' THEN {noisy} ELSE pos::DOUBLE END AS spot FROM b), {READ}
SELECT user_id, view::INT AS view, kind, pos::BIGINT AS pos, round({seen('value')}, 6) AS value, round({seen('k')}, 6) AS k FROM x"""


@query(_views(18))
def augment_two_views(t):
    return A.two_views(_panel(t), SCALE, 18).select("user_id", "view", "kind", F.col("pos").cast("long").alias("pos"), *[r6(F.col(c)).alias(c) for c in CHANNELS])
