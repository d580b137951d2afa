"""Per-key state over streams: alarm suppression and causal context, as the batch operators give them.

Rows of a key are taken in order of time and id within a micro-batch; a row that is older than one already taken but
within the watermark is taken when it comes, marked `late`; one behind the watermark is left out by Spark. State is a
position and the last kept alarm, or a ring of the last values, whatever a key's length. A timer at the newest row's
time plus `expire` removes a key's state once the watermark passes it; the key then starts anew. Both need Spark's
RocksDB state store (`spark.sql.streaming.stateStore.providerClass`), which keeps state in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """Sorted rows of a key, one at a time, with a state that expires."""

    state_kind: str

    def __init__(self, ts: str, order: str, expire_ms: int):
        self.ts, self.order, self.expire_ms = ts, order, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", f"{self.state_kind}, newest long")

    def begin(self) -> tuple:
        raise NotImplementedError

    def take(self, state: tuple, row) -> tuple[tuple, tuple]:
        """The state behind a row, and what is said of it."""
        raise NotImplementedError

    names: tuple[str, ...]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.ts, self.order])
        held = self.state.get() if self.state.exists() else None
        if held and held[-1] // 1000 + self.expire_ms <= timerValues.getCurrentWatermarkInMs():
            held = None  # rows come before timers that are due in the same micro-batch
        state, newest = (tuple(held[:-1]), held[-1]) if held else (self.begin(), None)
        said = []
        for row in batch.itertuples(index=False):
            at = int(getattr(row, self.ts).timestamp() * 1e6)
            state, out = self.take(state, row)
            said.append((key[0], getattr(row, self.order), newest is not None and at < newest, *out))
            newest = at if newest is None else max(at, newest)
        self.state.update((*state, newest))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest // 1000 + self.expire_ms)
        yield pd.DataFrame(said, columns=["key", "order", "late", *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Alarms(_Keyed):
    state_kind, names = "n long, last long", ("kept",)

    def __init__(self, alarm: str, delay: int, *rest):
        super().__init__(*rest)
        self.alarm, self.delay = alarm, delay

    def begin(self) -> tuple:
        return 0, -1

    def take(self, state: tuple, row) -> tuple[tuple, tuple]:
        n, last = state
        kept = bool(getattr(row, self.alarm)) and (n < self.delay or last < 0 or n - last > self.delay)
        return (n + 1, n if kept else last), (kept,)


class _Context(_Keyed):
    state_kind, names = "ring array<double>", ("context",)

    def __init__(self, value: str, width: int, *rest):
        super().__init__(*rest)
        self.value, self.width = value, width

    def begin(self) -> tuple:
        return ([],)

    def take(self, state: tuple, row) -> tuple[tuple, tuple]:
        ring = [*state[0], float(getattr(row, self.value))][-self.width :]
        return (ring[-(self.width - 1) :] if self.width > 1 else [],), (ring,)


def _run(events: DataFrame, processor: _Keyed, key: str, late: str, out: str, columns: list[str]) -> DataFrame:
    rows = events.select(key, *dict.fromkeys([processor.order, *columns]), F.col(processor.ts).cast("timestamp").alias(processor.ts)).withWatermark(processor.ts, late)
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, processor.order)}
    made = rows.groupBy(key).transformWithStateInPandas(processor, f"key {kinds[key]}, order {kinds[processor.order]}, late boolean, {out}", "Append", "EventTime")
    return made.withColumnsRenamed({"key": key, "order": processor.order})


def suppress_alarms(events: DataFrame, alarm: str, delay: int, late: str = "10 minutes", expire_ms: int = 7 * 86_400_000, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Each row with `kept`: an alarm stays unless a kept one lies within the `delay` rows before it; the first `delay` rows of a key are exempt."""
    return _run(events, _Alarms(alarm, delay, ts, order, expire_ms), key, late, "kept boolean", [alarm])


def causal_context(events: DataFrame, value: str, width: int, late: str = "10 minutes", expire_ms: int = 7 * 86_400_000, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Each row with `context`: its value behind those of up to width - 1 rows before it."""
    return _run(events, _Context(value, width, ts, order, expire_ms), key, late, "context array<double>", [value])
