"""Queries on the events panel: a series per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import series as S
from ..spec import SeriesSpec, r6
from .registry import Tables, query

EV = SeriesSpec(("user_id",), ("ts", "event_id"))
W = "(PARTITION BY user_id ORDER BY ts, event_id)"
RN = f"row_number() OVER {W} - 1"
NULLED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


def gaps(t: Tables) -> DataFrame:
    """events with derived nulls in v."""
    return t.events.withColumn("v", F.expr(NULLED))


@query(f"""WITH a AS (SELECT *, (({RN}) // 8)::BIGINT AS win, {RN} AS rn FROM events)
SELECT user_id, win, round(avg(value), 6) AS mean, max_by(value, rn) AS last FROM a GROUP BY user_id, win HAVING count(*) = 8""")
def fold_tumbling(t):
    return S.fold_tumbling(t.events, EV, 8, "value").select("user_id", "win", r6(F.col("mean")).alias("mean"), "last")


@query(f"""WITH a AS (SELECT *, (({RN}) // 8)::BIGINT AS win, {RN} AS rn FROM events),
f AS (SELECT user_id, win, avg(value) AS mean, max_by(value, rn) AS last FROM a GROUP BY user_id, win HAVING count(*) = 8),
p AS (SELECT *, lead(last) OVER (PARTITION BY user_id ORDER BY win) AS nxt FROM f)
SELECT round(sqrt(avg((nxt - mean) * (nxt - mean))), 6) AS rmse, count(nxt)::BIGINT AS n FROM p""")
def naive_forecast_rmse(t):
    f = S.fold_tumbling(t.events, EV, 8, "value").withColumn("nxt", F.lead("last").over(Window.partitionBy("user_id").orderBy("win")))
    return f.agg(r6(F.sqrt(F.avg((F.col("nxt") - F.col("mean")) ** 2))).alias("rmse"), F.count("nxt").alias("n"))


@query(f"""WITH a AS (SELECT user_id, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS mean, lead(value, 16) OVER {W} AS y1, lead(value, 17) OVER {W} AS y2 FROM events)
SELECT user_id, rn::BIGINT AS rn, round(mean, 6) AS mean, y1, y2 FROM a WHERE rn % 4 = 0 AND rn <= n - 18""")
def window_sliding_x(t):
    out = S.sliding(t.events, EV, 16, 4, 2, "value")
    return out.select("user_id", "rn", r6(F.aggregate("x", F.lit(0.0), lambda s, x: s + x) / 16).alias("mean"), "y1", "y2")


@query(f"""WITH a AS (SELECT user_id, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n, value AS tabular, lead(value, 7) OVER {W} AS nowcast, lead(value, 8) OVER {W} AS forecast FROM events)
SELECT user_id, rn::BIGINT AS rn, tabular, nowcast, forecast FROM a WHERE rn <= n - 9""")
def window_target(t):
    a = EV.numbered(t.events).withColumns({"n": EV.length(), "nowcast": F.lead("value", 7).over(EV.window()), "forecast": F.lead("value", 8).over(EV.window())})
    return a.filter(F.col("rn") <= F.col("n") - 9).select("user_id", "rn", F.col("value").alias("tabular"), "nowcast", "forecast")


@query(f"""WITH a AS (SELECT user_id, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, rn::BIGINT AS rn FROM a WHERE rn < n - 8 - 2""")
def window_seq2seq(t):
    return EV.numbered(t.events).withColumn("n", EV.length()).filter("rn < n - 8 - 2").select("user_id", "rn")


@query(f"""WITH a AS (SELECT *, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events), o AS (SELECT unnest([20, 26, 33, 40]) AS w)
SELECT user_id, w::BIGINT AS w, sum(CASE WHEN rn < w THEN 1 ELSE 0 END)::BIGINT AS train, sum(CASE WHEN rn >= w THEN 1 ELSE 0 END)::BIGINT AS test, round(avg(CASE WHEN rn < w THEN value END), 6) AS train_mean
FROM a, o WHERE rn < w + 5 AND w + 5 <= n GROUP BY user_id, w""")
def window_rolling_origin(t):
    first, last, n, h = 20, 40, 4, 5
    ends = [int(first + (last - first) * i / (n - 1)) for i in range(n)]
    a = EV.numbered(t.events).withColumn("n", EV.length()).withColumn("w", F.explode(F.array(*[F.lit(e).cast("bigint") for e in ends]))).filter((F.col("rn") < F.col("w") + h) & (F.col("w") + h <= F.col("n")))
    train = F.col("rn") < F.col("w")
    return a.groupBy("user_id", "w").agg(F.sum(train.cast("bigint")).alias("train"), F.sum((~train).cast("bigint")).alias("test"), r6(F.avg(F.when(train, F.col("value")))).alias("train_mean"))


@query(f"SELECT event_id, lead(value, 1) OVER {W} AS y1, lead(value, 2) OVER {W} AS y2, lead(value, 3) OVER {W} AS y3 FROM events QUALIFY {RN} >= 5")
def horizon_labels(t):
    a = EV.numbered(t.events).withColumns({f"y{k}": F.lead("value", k).over(EV.window()) for k in (1, 2, 3)})
    return a.filter("rn >= 5").select("event_id", "y1", "y2", "y3")


@query("SELECT user_id, greatest(10, ceil(count(*) * 0.2))::BIGINT AS h FROM events GROUP BY user_id")
def horizon_length(t):
    return t.events.groupBy("user_id").agg(F.greatest(F.lit(10), F.ceil(F.count("*") * F.lit(0.2))).cast("bigint").alias("h"))


@query(f"SELECT event_id, lag(value, 1) OVER {W} AS l1, lag(value, 3) OVER {W} AS l3 FROM events")
def lag_feature(t):
    return t.events.select("event_id", F.lag("value", 1).over(EV.window()).alias("l1"), F.lag("value", 3).over(EV.window()).alias("l3"))


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS m FROM events QUALIFY {RN} >= 4")
def rolling_mean(t):
    return S.rolling_mean(t.events, EV, 5, "value", "m").filter("m is not null").select("event_id", r6(F.col("m")).alias("m"))


@query(f"SELECT event_id, coalesce(lag(value, 2) OVER {W}, 0.0) AS back, coalesce(lead(value, 2) OVER {W}, 0.0) AS ahead FROM events")
def np_shift(t):
    return t.events.select("event_id", F.lag("value", 2, 0.0).over(EV.window()).alias("back"), F.lead("value", 2, 0.0).over(EV.window()).alias("ahead"))


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 20 PRECEDING), 6) AS m FROM events QUALIFY {RN} >= 20")
def moving_mean(t):
    return S.rolling_mean(t.events, EV, 21, "value", "m").filter("m is not null").select("event_id", r6(F.col("m")).alias("m"))


@query(f"SELECT event_id, round(avg(value) OVER w, 9) AS ex_mean, round(stddev_pop(value) OVER w, 9) AS ex_std FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) QUALIFY count(*) OVER w >= 6")
def expanding_mean_std(t):
    return S.expanding(t.events, EV, "value", 6).filter("ex_mean is not null").select("event_id", F.round("ex_mean", 9).alias("ex_mean"), F.round("ex_std", 9).alias("ex_std"))


@query("""WITH a AS (SELECT *, (value - avg(value) OVER (PARTITION BY user_id)) AS x FROM events)
SELECT event_id, round(sqrt(sum(x * x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5), 6) AS s FROM a""")
def rolling_std_centered(t):
    x = F.col("value") - F.avg("value").over(EV.whole())
    return t.events.withColumn("x", x).select("event_id", r6(F.sqrt(F.sum(F.col("x") * F.col("x")).over(EV.rows(-2, 2)) / 5)).alias("s"))


@query(f"SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER {W} AS delta FROM events QUALIFY delta IS NOT NULL")
def time_delta(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.withColumn("us", us).select("event_id", (F.col("us") - F.lag("us").over(EV.window())).alias("delta")).filter("delta is not null")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def tail_n_per_group(t):
    return S.tail(t.events, EV, 5).select("event_id")


@query(f"SELECT event_id FROM events QUALIFY ({RN}) % 6 = 0")
def stride_rows_per_group(t):
    return S.stride(t.events, EV, 6).select("event_id")


@query(f"SELECT event_id FROM events QUALIFY ({RN}) < 4")
def head_n(t):
    return S.head(t.events, EV, 4).select("event_id")


@query(f"SELECT event_id FROM events WHERE event_type = 'click' QUALIFY ({RN}) % 3 = 0")
def reduce_df(t):
    """Rows of one step, thinned within a series."""
    return S.stride(t.events.filter(F.col("event_type") == "click"), EV, 3).select("event_id")


@query(f"""WITH m AS (SELECT max(c) AS len FROM (SELECT count(*) AS c FROM events GROUP BY user_id)), g AS (SELECT user_id, unnest(range(0, (SELECT len FROM m))) AS step FROM (SELECT DISTINCT user_id FROM events)),
a AS (SELECT user_id, {RN} AS step, value FROM events)
SELECT g.user_id, g.step::BIGINT AS step, coalesce(a.value, 0.0) AS value FROM g LEFT JOIN a ON g.user_id = a.user_id AND g.step = a.step""")
def pad_to_max(t):
    a = EV.numbered(t.events, "step").select("user_id", "step", "value")
    most = t.events.groupBy("user_id").count().agg(F.max("count").alias("m"))
    grid = t.events.select("user_id").distinct().crossJoin(F.broadcast(most)).select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("step"))
    return grid.join(a, ["user_id", "step"], "left").select("user_id", "step", F.coalesce("value", F.lit(0.0)).alias("value"))


@query(f"""WITH g AS (SELECT user_id, unnest(range(0, 60)) AS step FROM (SELECT DISTINCT user_id FROM events)), a AS (SELECT user_id, {RN} AS step, value FROM events)
SELECT g.user_id, g.step::BIGINT AS step, coalesce(a.value, 0.0) AS value FROM g LEFT JOIN a ON g.user_id = a.user_id AND g.step = a.step""")
def pad_to_len(t):
    n = 60
    arr = EV.numbered(t.events).filter(F.col("rn") < n).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("x"))
    padded = arr.select("user_id", F.posexplode(F.slice(F.concat("x", F.array_repeat(F.lit(0.0), n)), 1, n)).alias("step", "value"))
    return padded.select("user_id", F.col("step").cast("bigint").alias("step"), "value")


@query(f"""WITH a AS (SELECT user_id, value, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT user_id, (rn + 5) % n AS rn, value FROM a) SELECT user_id, rn::BIGINT AS rn, value FROM b""")
def roll_columns(t):
    a = EV.numbered(t.events).withColumn("n", EV.length())
    return a.select("user_id", F.pmod(F.col("rn") + 5, "n").alias("rn"), "value")


def _acf(lags):
    return " UNION ALL ".join(f"SELECT user_id, {k}::INT AS lag, round(sum(x * l{k}) / sum(x * x), 6) AS acf FROM b GROUP BY user_id" for k in lags)


@query(f"WITH a AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events), b AS (SELECT *, lead(x, 1) OVER {W} AS l1, lead(x, 2) OVER {W} AS l2, lead(x, 5) OVER {W} AS l5 FROM a) {_acf((1, 2, 5))}")
def acf(t):
    return S.acf(t.events, EV, "value", [1, 2, 5]).select("user_id", "lag", r6(F.col("acf")).alias("acf"))


@query(f"WITH a AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events), b AS (SELECT *, lead(x, 1) OVER {W} AS l1, lead(x, 2) OVER {W} AS l2, lead(x, 5) OVER {W} AS l5 FROM a), c AS ({_acf((1, 2, 5))}) SELECT a.user_id, round(avg(abs(a.acf - b.acf)), 3) AS d FROM c a JOIN c b ON b.user_id = a.user_id + 1 AND a.lag = b.lag GROUP BY a.user_id")
def acf_diff(t):
    c = S.acf(t.events, EV, "value", [1, 2, 5]).withColumn("acf", r6(F.col("acf")))
    nxt = c.select((F.col("user_id") - 1).alias("user_id"), "lag", F.col("acf").alias("other"))
    return c.join(nxt, ["user_id", "lag"]).groupBy("user_id").agg(F.round(F.avg(F.abs(F.col("acf") - F.col("other"))), 3).alias("d"))


DFT = """WITH a AS (SELECT user_id, value - {centre} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT a.*, unnest(range(1, (n // 2 + 1)::BIGINT)) AS k FROM a),
p AS (SELECT user_id, k, n, power(sum(x * cos(2 * pi() * k * rn / n)), 2) + power(sum(x * sin(2 * pi() * k * rn / n)), 2) AS power FROM k GROUP BY user_id, k, n)"""
CENTRED = DFT.format(centre="avg(value) OVER (PARTITION BY user_id)")


@query(CENTRED + " SELECT user_id, round(max(power) / (sum(power) + 1e-8), 6) AS score FROM p GROUP BY user_id")
def cyclicity_score(t):
    return S.spectrum(t.events, EV, "value").groupBy("user_id").agg(r6(F.max("power") / (F.sum("power") + 1e-8)).alias("score"))


@query(CENTRED + ", r AS (SELECT user_id, k, n, power / (sum(power) OVER (PARTITION BY user_id) + 1e-12) AS ratio FROM p) SELECT user_id, round(k::DOUBLE / n, 6) AS freq, round(ratio, 6) AS ratio FROM r WHERE ratio >= 0.05 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ratio DESC, k) <= 3")
def multi_cyclicity(t):
    p = S.spectrum(t.events, EV, "value").withColumn("ratio", F.col("power") / (F.sum("power").over(EV.whole()) + 1e-12))
    top = p.withColumn("r", F.row_number().over(EV.whole().orderBy(F.desc("ratio"), "k"))).filter("r <= 3 and ratio >= 0.05")
    return top.select("user_id", r6(F.col("k") / F.col("n")).alias("freq"), r6(F.col("ratio")).alias("ratio"))


@query(DFT.format(centre="0") + " SELECT user_id, round(n::DOUBLE / k)::BIGINT AS period FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY power DESC, k) AS r FROM p) WHERE r <= 3 AND round(n::DOUBLE / k) <= n // 4")
def dominant_periods(t):
    p = S.spectrum(t.events, EV, "value", centre=False).withColumn("r", F.row_number().over(EV.whole().orderBy(F.desc("power"), "k")))
    return p.filter("r <= 3").withColumn("period", F.round(F.col("n") / F.col("k")).cast("bigint")).filter("period <= n div 4").select("user_id", "period")


@query(CENTRED + " SELECT user_id, max(power) / (sum(power) + 1e-8) > 0.2 AS cyclic FROM p GROUP BY user_id")
def split_linear_cyclic(t):
    score = F.max("power") / (F.sum("power") + 1e-8)
    return S.spectrum(t.events, EV, "value").groupBy("user_id").agg((~F.isnan(score) & (score > 0.2)).alias("cyclic"))


@query(CENTRED + " SELECT user_id, max(power) > 5 * avg(power) AS strong FROM p GROUP BY user_id")
def periodogram_flag(t):
    return S.spectrum(t.events, EV, "value").groupBy("user_id").agg((F.max("power") > 5 * F.avg("power")).alias("strong"))


@query(CENTRED + ", d AS (SELECT user_id, round(n::DOUBLE / k)::BIGINT AS period FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY power DESC, k) = 1) SELECT period, count(*)::BIGINT AS votes FROM d GROUP BY period ORDER BY votes DESC, period LIMIT 1")
def dominant_period_mode(t):
    top = S.spectrum(t.events, EV, "value").withColumn("r", F.row_number().over(EV.whole().orderBy(F.desc("power"), "k"))).filter("r = 1")
    return top.groupBy(F.round(F.col("n") / F.col("k")).cast("bigint").alias("period")).agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "period").limit(1)


@query(f"""WITH a AS (SELECT user_id, value, cos(2 * pi() * ({RN}) / 12) AS c, sin(2 * pi() * ({RN}) / 12) AS s FROM events)
SELECT user_id, round((sum(c * value) * sum(s * s) - sum(s * value) * sum(c * s)) / (sum(c * c) * sum(s * s) - sum(c * s) * sum(c * s)), 6) AS bc, round((sum(s * value) * sum(c * c) - sum(c * value) * sum(c * s)) / (sum(c * c) * sum(s * s) - sum(c * s) * sum(c * s)), 6) AS bs FROM a GROUP BY user_id""")
def seasonal_fit(t):
    angle = F.lit(2.0) * F.pi() * F.col("rn") / 12
    a = EV.numbered(t.events).withColumns({"c": F.cos(angle), "s": F.sin(angle)})
    cc, ss, cs, cy, sy = (F.sum(F.col(x) * F.col(y)) for x, y in (("c", "c"), ("s", "s"), ("c", "s"), ("c", "value"), ("s", "value")))
    det = cc * ss - cs * cs
    return a.groupBy("user_id").agg(r6((cy * ss - sy * cs) / det).alias("bc"), r6((sy * cc - cy * cs) / det).alias("bs"))


@query(f"SELECT user_id, round(greatest(abs(corr(value, s)), abs(corr(value, c))), 6) AS a FROM (SELECT user_id, value, sin(0.5 * ({RN})) AS s, cos(0.5 * ({RN})) AS c FROM events) GROUP BY user_id")
def phase_alignment(t):
    a = EV.numbered(t.events).withColumns({"s": F.sin(F.col("rn") * 0.5), "c": F.cos(F.col("rn") * 0.5)})
    return a.groupBy("user_id").agg(r6(F.greatest(F.abs(F.corr("value", "s")), F.abs(F.corr("value", "c")))).alias("a"))


@query(f"SELECT event_id, round(cos(2 * pi() * ({RN}) / 7), 6) + 0.0 AS c7, round(sin(2 * pi() * ({RN}) / 24), 6) + 0.0 AS s24 FROM events")
def phase_encode(t):
    return EV.numbered(t.events).select("event_id", (r6(F.cos(F.lit(2.0) * F.pi() * F.col("rn") / 7)) + 0.0).alias("c7"), (r6(F.sin(F.lit(2.0) * F.pi() * F.col("rn") / 24)) + 0.0).alias("s24"))


@query(f"""WITH e AS (SELECT *, {NULLED} AS v, {RN} AS rn FROM events),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS pr, first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS nr FROM e
WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, pv + (nv - pv) * (rn - pr) / nullif(nr - pr, 0), pv, nv), 6) AS filled FROM b""")
def fill_linear(t):
    return S.fill_linear(gaps(t), EV, "v", "filled").select("event_id", r6(F.col("filled")).alias("filled"))


@query(f"""WITH e AS (SELECT *, {NULLED} AS v FROM events) SELECT event_id, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS filled FROM e""")
def fill_backward_forward(t):
    return S.fill_backward_forward(gaps(t), EV, "v", "filled").select("event_id", "filled")


@query(f"SELECT event_id, coalesce({NULLED}, 0.0) AS filled FROM events")
def fill_zero(t):
    return gaps(t).select("event_id", F.coalesce("v", F.lit(0.0)).alias("filled"))


@query(f"WITH e AS (SELECT *, {NULLED} AS v FROM events) SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY user_id)), 6) AS filled FROM e")
def fill_mean(t):
    return gaps(t).select("event_id", r6(F.coalesce("v", F.avg("v").over(EV.whole()))).alias("filled"))


@query(f"SELECT user_id, round(sum(CASE WHEN {NULLED} IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS share FROM events GROUP BY user_id")
def missing_fraction(t):
    return gaps(t).groupBy("user_id").agg(r6(F.sum(F.col("v").isNull().cast("int")) / F.count("*")).alias("share"))


@query(f"""WITH e AS (SELECT *, {NULLED} AS v FROM events WHERE {NULLED} IS NOT NULL), m AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM e GROUP BY user_id))
SELECT event_id FROM e QUALIFY row_number() OVER {W} <= (SELECT c FROM m)""")
def drop_null_target_per_page_truncate(t):
    known = gaps(t).filter("v is not null")
    least = known.groupBy("user_id").count().agg(F.min("count").alias("c"))
    return EV.numbered(known).crossJoin(F.broadcast(least)).filter("rn < c").select("event_id")


@query(f"SELECT event_id, {NULLED} AS v, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, 0) AS other FROM events WHERE {NULLED} IS NOT NULL")
def filter_not_null_target(t):
    return gaps(t).withColumn("other", F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END")).filter("v is not null").fillna(0.0, ["other"]).select("event_id", "v", "other")


@query("""WITH s AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS d FROM events) SELECT event_id, round(least(greatest(value, m - 3 * d), m + 3 * d), 6) AS v FROM s""")
def clip_sigma(t):
    return t.events.select("event_id", r6(E.clip_sigma(EV, "value")).alias("v"))


@query("SELECT event_id, least(greatest(value * 50, -1000), 1000) AS v FROM events")
def clip_const(t):
    return t.events.select("event_id", E.clip(F.col("value") * 50, -1000.0, 1000.0).alias("v"))


@query("""WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id), d AS (SELECT user_id, median(abs(value - med)) AS mad FROM events JOIN m USING (user_id) GROUP BY user_id)
SELECT event_id FROM events JOIN m USING (user_id) JOIN d USING (user_id) WHERE mad > 0 AND abs(0.6745 * (value - med) / mad) > 3""")
def spike_mad(t):
    return E.spikes_mad(t.events, ("user_id",), "value").select("event_id")


@query("SELECT event_id FROM (SELECT *, (value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0) AS z FROM events) WHERE abs(z) > 2.5")
def spike_zscore(t):
    z = (F.col("value") - F.avg("value").over(EV.whole())) / F.nullif(F.stddev_pop("value").over(EV.whole()), F.lit(0.0))
    return t.events.withColumn("z", z).filter("abs(z) > 2.5").select("event_id")


@query("""WITH m AS (SELECT user_id, median(value) AS med, max(value) - min(value) AS r, stddev_pop(value) AS s FROM events GROUP BY user_id)
SELECT user_id, round(greatest(0.5 * median(abs(value - med)), 1e-12), 6) AS by_mad, round(greatest(0.5 * any_value(s), 1e-12), 6) AS by_std, round(greatest(0.5 * any_value(r), 1e-12), 6) AS by_range FROM events JOIN m USING (user_id) GROUP BY user_id""")
def rdp_epsilon(t):
    m = t.events.groupBy("user_id").agg(F.median("value").alias("med"), (F.max("value") - F.min("value")).alias("r"), F.stddev_pop("value").alias("s"))
    out = t.events.join(m, "user_id").groupBy("user_id").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.first("s").alias("s"), F.first("r").alias("r"))
    e = lambda c: r6(F.greatest(F.lit(0.5) * F.col(c), F.lit(1e-12)))
    return out.select("user_id", e("mad").alias("by_mad"), e("s").alias("by_std"), e("r").alias("by_range"))


@query(f"""WITH a AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))::DOUBLE AS x, {RN} AS rn FROM events),
g AS (SELECT *, coalesce(abs((x - lag(x) OVER w) * (lead(value) OVER w - lag(value) OVER w) - (lead(x) OVER w - lag(x) OVER w) * (value - lag(value) OVER w)) / 2, 'inf'::DOUBLE) AS area FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY area DESC, rn) <= 20""")
def vw_union(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    a = EV.numbered(t.events).withColumn("x", (us - F.min(us).over(EV.whole())).cast("double"))
    g = S.triangle_areas(a, EV, "x", "value")
    return g.withColumn("r", F.row_number().over(EV.whole().orderBy(F.desc("area"), "rn"))).filter("r <= 20").select("event_id")


@query(f"SELECT user_id, round(count(*)::DOUBLE / sum(CASE WHEN rn % 6 = 0 THEN 1 ELSE 0 END), 6) AS ratio FROM (SELECT user_id, {RN} AS rn FROM events) GROUP BY user_id")
def compression_ratio(t):
    return EV.numbered(t.events).groupBy("user_id").agg(r6(F.count("*") / F.sum((F.col("rn") % 6 == 0).cast("int"))).alias("ratio"))


@query(f"SELECT event_id, round((value - m) / m, 6) AS score FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) AS m, {RN} AS rn FROM events) WHERE rn >= 21 AND m <> 0")
def anomaly_score(t):
    a = S.rolling_mean(t.events, EV, 21, "value", "m", lag=1).filter("m <> 0")
    return a.select("event_id", r6((F.col("value") - F.col("m")) / F.col("m")).alias("score"))


@query(f"WITH a AS (SELECT *, {RN} AS rn FROM events), s AS (SELECT user_id, avg(value) + 1.5 * stddev_pop(value) AS limit_ FROM a WHERE rn >= 22 GROUP BY user_id) SELECT event_id FROM a JOIN s USING (user_id) WHERE value > limit_")
def anomaly_threshold(t):
    a = EV.numbered(t.events)
    s = a.filter("rn >= 22").groupBy("user_id").agg((F.avg("value") + 1.5 * F.stddev_pop("value")).alias("limit_"))
    return a.join(s, "user_id").filter("value > limit_").select("event_id")


@query("SELECT event_id FROM (SELECT *, avg(value) OVER w + 1.5 * stddev_pop(value) OVER w AS limit_, count(*) OVER w AS c, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE c > n // 10 AND value > limit_")
def anomaly_threshold_expanding(t):
    a = EV.numbered(S.expanding(t.events, EV, "value", 1)).withColumn("n", EV.length())
    return a.filter("rn + 1 > n div 10 and value > ex_mean + 1.5 * ex_std").select("event_id")


@query(f"""WITH RECURSIVE p AS (SELECT user_id, rn, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS i FROM (SELECT user_id, value, {RN} AS rn FROM events) WHERE value > 60),
f AS (SELECT user_id, i, rn, true AS keep, rn AS last FROM p WHERE i = 1
UNION ALL SELECT p.user_id, p.i, p.rn, (p.rn < 3 OR p.rn - f.last > 3), CASE WHEN p.rn < 3 OR p.rn - f.last > 3 THEN p.rn ELSE f.last END FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1)
SELECT user_id, rn::BIGINT AS rn FROM f WHERE keep""")
def alarm_suppress(t):
    return S.alarm_suppress(t.events.withColumn("a", F.col("value") > 60), EV, "a", 3)


ADJUSTED = f"""a AS (SELECT *, CASE WHEN (({RN}) // 6) % 3 = 1 THEN 1 ELSE 0 END AS y, CASE WHEN value > 70 THEN 1 ELSE 0 END AS p, {RN} AS rn FROM events),
c AS (SELECT *, CASE WHEN y = lag(y) OVER {W} THEN 0 ELSE 1 END AS ch FROM a), g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS at_ FROM g),
j AS (SELECT *, CASE WHEN y = 1 THEN max(CASE WHEN at_ <= 3 THEN p END) OVER (PARTITION BY user_id, seg) ELSE p END AS adjusted FROM h)"""


def _adjusted(t):
    a = EV.numbered(t.events).withColumns({"y": F.expr("cast((rn div 6) % 3 = 1 as int)"), "p": (F.col("value") > 70).cast("int")})
    return S.point_adjust(a, EV, "y", "p", 2)


@query(f"WITH {ADJUSTED} SELECT event_id, adjusted::INT AS adjusted FROM j")
def point_adjust(t):
    return _adjusted(t).select("event_id", "adjusted")


@query(f"WITH {ADJUSTED} SELECT round(sum(y * adjusted)::DOUBLE / sum(adjusted), 6) AS p, round(sum(y * adjusted)::DOUBLE / sum(y), 6) AS r, round(2.0 * sum(y * adjusted) / (sum(y) + sum(adjusted)), 6) AS f1 FROM j")
def precision_recall_f1(t):
    tp, y, p = F.sum(F.col("y") * F.col("adjusted")), F.sum("y"), F.sum("adjusted")
    return _adjusted(t).agg(r6(tp / p).alias("p"), r6(tp / y).alias("r"), r6(2.0 * tp / (y + p)).alias("f1"))


@query("""WITH d AS (SELECT user_id, date_trunc('hour', ts) AS h, max(CASE WHEN value > 70 THEN 1 ELSE 0 END) AS y FROM events GROUP BY ALL), g AS (SELECT user_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM d GROUP BY user_id)
SELECT g.user_id, epoch_us(g.h) AS us, coalesce(d.y, 0)::INT AS y FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.h = d.h""")
def regularize_labels(t):
    hour = 3_600_000_000
    d = t.events.withColumn("us", F.expr(f"(unix_micros(cast(ts as timestamp)) div {hour}) * {hour}")).groupBy("user_id", "us").agg(F.max((F.col("value") > 70).cast("int")).alias("y"))
    g = d.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b")).select("user_id", F.explode(F.expr(f"sequence(a, b, {hour}L)")).alias("us"))
    return g.join(d, ["user_id", "us"], "left").select("user_id", "us", F.coalesce("y", F.lit(0)).alias("y"))
