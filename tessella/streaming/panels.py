"""Structured Streaming forms: event-time aggregation with late-data rules, and causal per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar(events: DataFrame, every: str, late: str, key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and means by key and tumbling window; rows later than `late` behind the newest are left out, and windows close by then."""
    # Only the zoned type can carry a watermark.
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(key, F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of a key: rows closer than the gap."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def trailing_mean(events: DataFrame, width: int, key: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """Each row with the mean of itself and the width - 1 before it in arrival order (within a micro-batch by `order`); the state is a ring of that many numbers a key."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        whole = pd.Series(held + rows[value].tolist(), dtype=float)
        means = whole.rolling(width, min_periods=1).mean().iloc[len(held) :]
        state.update((whole.iloc[-(width - 1) :].tolist() if width > 1 else [],))
        yield pd.DataFrame({key: name[0], order: rows[order].to_numpy(), "trailing": means.to_numpy()})

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, trailing double", "held array<double>", "append", "NoTimeout")
