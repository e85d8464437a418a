"""States that time ends: retries that come due, and ordered folds whose state goes once it says nothing more.

Timers are of event time: they fire when the watermark has passed them. Spark keeps the states in RocksDB, so they may outgrow memory.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType, _parse_datatype_string

from .folds import Step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Seconds until the first, second and third retry.
DELAYS = (60, 300, 1800)


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their states in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def timed(events: DataFrame, late: str) -> DataFrame:
    """events(at in seconds, ...) with a watermark, as the operators below take them."""
    return events.withColumn("seen", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("long"))).withWatermark("seen", late)


class _TimedFold(StatefulProcessor):
    def __init__(self, order: list[str], step: Step, names: list[str], ends: Callable):
        self.order, self.step, self.names, self.ends = order, step, names, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "json string, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        now = json.loads(held[0]) if held else None
        for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            now, out = self.step(now, row.asDict())
            for values in out:
                yield Row(**dict(zip(self.names, values)))
        end = None if now is None else self.ends(now)
        timer = -1 if end is None else math.ceil(end * 1000)
        if held and held[1] >= 0 and held[1] != timer:
            self.handle.deleteTimer(held[1])
        if timer >= 0:
            self.handle.registerTimer(timer)
        if now is not None:
            self.state.update((json.dumps(now), timer))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.state.exists() and self.state.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())


def _transformed(events: DataFrame, key: str, processor: StatefulProcessor, schema: StructType) -> DataFrame:
    return events.groupBy(key).transformWithState(processor, schema, "append", "eventTime")


def fold(events: DataFrame, key: str, order: list[str], step: Step, schema: str, ends: Callable) -> DataFrame:
    """The output rows of a step of folds over timed events. ends(state) is the second from which the state is as good as none, or None; it is dropped there."""
    parsed = _parse_datatype_string(schema)
    return _transformed(events, key, _TimedFold(order, step, parsed.names, ends), parsed)


def window_ends(seconds: float) -> Callable:
    """When a window of folds.fixed_window is over."""
    return lambda state: state[0] + seconds


def bucket_fills(rate: float, most: float) -> Callable:
    """When a bucket of folds.token_bucket is full again."""
    return lambda state: state[1] + (most - state[0]) / rate


def cooldown_ends(seconds: float) -> Callable:
    """When folds.cooldown lets alerts through again."""
    return lambda state: state + seconds


class _Retries(StatefulProcessor):
    def __init__(self, delays: tuple, forget: float):
        self.delays, self.forget = delays, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "n int, timer long")
        self.pending = handle.getMapState("pending", "ms long, id long", "due double, tries int")
        self.errors = handle.getListState("errors", "id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.tries.get() if self.tries.exists() else None
        n, timer = held or (0, -1)
        last = 0.0
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            last = row["at"]
            if not row["failed"]:
                n = 0
                self.errors.clear()
                continue
            self.errors.appendValue((row["id"],))
            n += 1
            if n > len(self.delays):
                yield Row(key=key[0], id=row["id"], outcome="dead", at=float(row["at"]), tries=n, errors=[e[0] for e in self.errors.get()])
                n = 0
                self.errors.clear()
                continue
            due = row["at"] + self.delays[n - 1]
            ms = math.ceil(due * 1000)
            self.pending.updateValue((ms, row["id"]), (float(due), n))
            self.handle.registerTimer(ms)
        end = math.ceil((last + self.forget) * 1000)
        if timer not in (-1, end):
            self.handle.deleteTimer(timer)
            for (ms, _) in list(self.pending.keys()):
                if ms == timer:
                    self.handle.registerTimer(timer)
        self.handle.registerTimer(end)
        self.tries.update((n, end))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (ms, id), (due, tries) in sorted(self.pending.iterator()):
            if ms == now:
                self.pending.removeKey((ms, id))
                yield Row(key=key[0], id=id, outcome="retry", at=due, tries=tries, errors=None)
        if self.tries.exists() and self.tries.get()[1] == now:
            self.tries.clear()
            self.errors.clear()


def retries(events: DataFrame, delays: tuple = DELAYS, forget: float = 86_400 * 365) -> DataFrame:
    """key, id, outcome, at, tries, errors of timed events(key, id, at, failed): a failed job comes again ("retry") when its delay is over.

    The fourth failure in a row, less successes, is a dead letter ("dead") with the ids of all that failed before it. A key without events for so many seconds
    is forgotten, which must be longer than the delays.
    """
    schema = _parse_datatype_string("key long, id long, outcome string, at double, tries int, errors array<long>")
    return _transformed(events, "key", _Retries(delays, forget), schema)
