"""Edge rules of the series operators on small literal inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import grouped as G
from tessella.operators import series as S
from tessella.spec import SeriesSpec

SPEC = SeriesSpec(("k",), ("t",))


def panel(spark, *series):
    return spark.createDataFrame([(k, t, v) for k, xs in enumerate(series) for t, v in enumerate(xs)], "k int, t int, v double")


def test_fold_drops_the_remainder(spark):
    out = S.fold_tumbling(panel(spark, [1.0, 3.0, 5.0, 7.0, 9.0], [1.0]), SPEC, 2, "v").orderBy("win").collect()
    assert [(r["k"], r["win"], r["mean"], r["last"]) for r in out] == [(0, 0, 2.0, 3.0), (0, 1, 6.0, 7.0)]


def test_sliding_stops_at_the_last_full_start(spark):
    df = panel(spark, [float(i) for i in range(10)], [0.0] * 4)
    out = S.sliding(df, SPEC, 4, 3, 1, "v").orderBy("rn").collect()
    assert [(r["k"], r["rn"], len(r["x"]), r["y1"]) for r in out] == [(0, 0, 4, 4.0), (0, 3, 4, 7.0)]


def test_linear_fill_takes_the_nearest_value_at_edges(spark):
    out = S.fill_linear(panel(spark, [None, 2.0, None, 6.0, None]), SPEC, "v", "f").orderBy("t").collect()
    assert [r["f"] for r in out] == [2.0, 2.0, 4.0, 6.0, 6.0]


def test_suppressed_alarms_do_not_count(spark):
    df = panel(spark, [1.0 if i in (1, 2, 3, 6, 9) else 0.0 for i in range(12)]).withColumn("a", F.col("v") > 0)
    assert sorted(r["rn"] for r in S.alarm_suppress(df, SPEC, "a", 3).collect()) == [1, 2, 6]


def test_a_late_hit_misses_the_segment(spark):
    df = panel(spark, [0.0] * 14).withColumn("y", (F.col("t") >= 2).cast("int") * (F.col("t") < 12).cast("int"))
    late = S.point_adjust(df.withColumn("p", (F.col("t") == 6).cast("int")), SPEC, "y", "p", 3)
    soon = S.point_adjust(df.withColumn("p", (F.col("t") == 5).cast("int")), SPEC, "y", "p", 3)
    assert late.agg(F.sum("adjusted")).first()[0] == 0
    assert soon.agg(F.sum("adjusted")).first()[0] == 10


def test_strides_must_be_positive(spark):
    for f in (S.stride, S.head):
        with pytest.raises(ValueError):
            f(panel(spark, [1.0]), SPEC, 0)


def test_spectrum_agrees_with_the_fast_transform(spark):
    x = np.random.default_rng(1).normal(size=17)
    got = [r["power"] for r in S.spectrum(panel(spark, [float(v) for v in x]), SPEC, "v").orderBy("k").collect()]
    assert np.allclose(got, np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2)


def test_thinned_series_are_subsets_with_both_ends():
    y = np.random.default_rng(2).normal(size=60)
    for kept in (G.lttb_indices(y, 12), G.rdp_indices(y, 0.7)):
        assert kept[0] == 0 and kept[-1] == 59 and len(set(kept)) == len(kept) < 60
    assert len(G.lttb_indices(y, 12)) == 12
    assert list(G.rdp_indices(np.arange(9.0), 0.1)) == [0, 8]
    assert G.dtw_distance(np.array([1.0, 2.0, 3.0]), np.array([1.0, 2.0, 2.0, 3.0])) == 0.0
