"""Queries on the descriptors of windows of the events panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptors as D
from ..spec import SeriesSpec
from .registry import query

EV = SeriesSpec(("user_id",), ("ts", "event_id"))
SIZE, STRIDE = 48, 12
H = "(PARTITION BY user_id, win)"
R = "(PARTITION BY user_id, win ORDER BY i)"


def _mode(k: int) -> str:
    return f"(SELECT list_avg([low + (j + 0.5::DOUBLE) * (high - low) / {k} FOR j IN range({k}) IF c{k}[j + 1] = list_max(c{k})]))"


def _entropy(counts: str, n: int) -> str:
    return f"list_sum([CASE WHEN c > 0 THEN -(c / {n}::DOUBLE) * ln(c / {n}::DOUBLE) ELSE 0 END FOR c IN {counts}])"


def _counts(value: str, n: int) -> str:
    return "[" + ", ".join(f"count_if(({value}) = {k})" for k in range(n)) + "]"


def _bin(k: int, pad: float) -> str:
    return f"least(floor((z - (low - {pad}::DOUBLE)) / ((high - low + {2 * pad}::DOUBLE) / {k})), {k - 1})::INT"


@query(f"""WITH s AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT user_id, win, rn - win * {STRIDE} AS i, x FROM s, range(100000) r(win) WHERE rn >= win * {STRIDE} AND rn < win * {STRIDE} + {SIZE} AND win * {STRIDE} + {SIZE} <= n),
a AS (SELECT user_id, win, i, (x - avg(x) OVER {H}) / stddev_samp(x) OVER {H} AS z FROM w),
b AS (SELECT *, min(z) OVER {H} AS low, max(z) OVER {H} AS high, quantile_cont(z, 1 / 3.0::DOUBLE) OVER {H} AS q1, quantile_cont(z, 2 / 3.0::DOUBLE) OVER {H} AS q2 FROM a),
c AS (SELECT *, {_bin(5, 0.0)} AS b5, {_bin(10, 0.0)} AS b10, {_bin(5, 0.1)} AS e5, CASE WHEN z > q2 THEN 2 WHEN z > q1 THEN 1 ELSE 0 END AS letter, z - lag(z) OVER {R} AS step FROM b),
d AS (SELECT *, lag(e5, 2) OVER {R} AS before, lag(letter) OVER {R} * 3 + letter AS pair, CASE WHEN i >= 3 THEN z - avg(z) OVER (PARTITION BY user_id, win ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS off,
    i - coalesce(max(CASE WHEN z <= 0 THEN i END) OVER {R}, -1) AS above, i - max(CASE WHEN step IS NULL OR step >= 0 THEN i END) OVER {R} AS falls FROM c),
g AS (SELECT user_id, win, min(low) AS low, max(high) AS high, {_counts('b5', 5)} AS c5, {_counts('b10', 10)} AS c10, {_counts('pair', 9)} AS motifs, {_counts('before * 5 + e5', 25)} AS joint,
    {_counts('CASE WHEN before IS NOT NULL THEN e5 END', 5)} AS sec, {_counts('before', 5)} AS fir, avg(step ** 3) AS time_reversal, avg((abs(step) * 1000 > 40)::INT) AS big_steps, max(above)::DOUBLE AS longest_above_mean,
    max(falls)::DOUBLE AS longest_fall, stddev_samp(off) AS mean3_error FROM d GROUP BY user_id, win)
SELECT user_id, win::BIGINT AS win, round({_mode(5)}, 6) AS histogram_mode_5, round({_mode(10)}, 6) AS histogram_mode_10, round({_entropy('fir', SIZE - 2)} + {_entropy('sec', SIZE - 2)} - {_entropy('joint', SIZE - 2)}, 6) AS histogram_information_2,
    round(time_reversal, 6) AS time_reversal, round(big_steps, 6) AS big_steps, longest_above_mean, longest_fall, round({_entropy('motifs', SIZE - 1)}, 6) AS motif_entropy, round(mean3_error, 6) AS mean3_error FROM g""")
def catch22_aggregates(t):
    """The nine descriptors that are aggregates."""
    out = D.describe(t.events, EV, "value", SIZE, STRIDE)
    return out.select("user_id", F.col("win").cast("long").alias("win"), *[F.round(c, 6).alias(c) for c in D.AGGREGATED])


@query()
def catch22(t):
    """All 22 of each window."""
    out = D.describe(t.events, EV, "value", SIZE, STRIDE)
    return out.select("user_id", F.col("win").cast("long").alias("win"), *[F.round(c, 6).alias(c) for c in D.NAMES])
