"""Streams in several micro-batches against the batch operators."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import series as S
from tessella.spec import SeriesSpec
from tessella.streaming import stateful

EV = SeriesSpec(("user_id",), ("ts", "event_id"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def store(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def _streamed(spark, make, batches, path):
    """The rows of a stream that reads one file a micro-batch."""
    for k, b in enumerate(batches):
        b.coalesce(1).write.parquet(f"{path}/in", mode="append")
        files = [f for f in os.listdir(f"{path}/in") if f.endswith(".parquet") and not f.startswith("n")]
        os.rename(f"{path}/in/{files[0]}", f"{path}/in/n{k}.parquet")
        os.utime(f"{path}/in/n{k}.parquet", (k + 1, k + 1))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = make(stream).writeStream.format("memory").queryName("got").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table("got").collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_streams_are_the_batch_operators(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "value", (F.col("value") > 20).alias("a"))
    cuts = [r["ts"] for r in events.orderBy("ts").collect()][::250][1:]
    part = sum((F.col("ts") >= F.lit(c)).cast("int") for c in cuts)
    batches = [events.filter(part == k) for k in range(len(cuts) + 1)]
    got = _streamed(spark, lambda s: stateful.suppress_alarms(s, "a", 3), batches, tmp_path / "a")
    kept = {(r["user_id"], r["event_id"]) for r in got if r["kept"]}
    rows = EV.numbered(events)
    want = S.alarm_suppress(events, EV, "a", 3).join(rows, ["user_id", "rn"])
    assert kept == {(r["user_id"], r["event_id"]) for r in want.collect()} and len(got) == events.count() and not any(r["late"] for r in got) and 0 < len(kept) < events.filter("a").count()
    spark.catalog.dropTempView("got")
    got = _streamed(spark, lambda s: stateful.causal_context(s, "value", 4), batches, tmp_path / "b")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    want = {r["event_id"]: r["c"] for r in events.withColumn("c", F.collect_list("value").over(w)).collect()}
    assert {r["event_id"]: r["context"] for r in got} == want
    spark.catalog.dropTempView("got")


def test_late_rows_and_expiry(spark, tmp_path):
    def rows(*at):
        return spark.createDataFrame([(i, m * 60, 1, float(i)) for i, m in at], "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")

    # minutes; ten of lateness. 3 comes late, 4 behind the watermark, and after 500 minutes the state is gone
    batches = [rows((0, 100), (1, 105)), rows((2, 120)), rows((3, 115)), rows((4, 10)), rows((5, 800)), rows((6, 801))]
    other = rows((90, 790)).withColumn("user_id", F.lit(2).cast("long"))
    batches.insert(4, other)  # moves the watermark
    got = {r["event_id"]: r for r in _streamed(spark, lambda s: stateful.causal_context(s, "value", 3, "10 minutes", 500 * 60_000), batches, tmp_path)}
    spark.catalog.dropTempView("got")
    assert 4 not in got and got[3]["late"] and got[3]["context"] == [1.0, 2.0, 3.0] and not got[2]["late"]
    assert got[5]["context"] == [5.0] and got[6]["context"] == [5.0, 6.0] and got[90]["context"] == [90.0]
