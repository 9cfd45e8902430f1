"""Live activity: which sessions are new, active or idle, by state and timers kept for each session."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

IDLE = "30 seconds"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000}


def _milliseconds(interval: str) -> int:
    n, unit = re.fullmatch(r"\s*(\d+)\s*(\w+?)s?\s*", interval).groups()
    return int(n) * _UNITS[unit]


class ActivityProcessor(StatefulProcessor):
    """Emits (event, at) of a session: ``added`` at its first line ever, else ``refresh`` once a batch; ``active`` where its lines begin
    after a silence, ``idle`` as soon as ``idle_ms`` have gone by without one. at is in milliseconds.

    Its state is one long, the last line's time, negative once the session is idle: the session stays known. A timer stands at
    last + idle_ms. By processing time a batch's lines all come at the batch's time; by event time each
    comes at its own, and silences inside a batch count.
    """

    def __init__(self, idle_ms: int, by_event_time: bool):
        self.idle_ms, self.by_event_time = idle_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ms", LongType())]))

    def _set(self, ms: int) -> None:
        self.last.update((ms,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        S = key[0]
        if self.by_event_time:
            times = sorted({r.ms for r in rows if r.ms is not None})
        else:
            times = [timerValues.getCurrentProcessingTimeInMs()]
        if not times:
            return
        known = self.last.exists()
        last = self.last.get()[0] if known else -1
        yield Row(S=S, event="refresh" if known else "added", at=times[0])
        before = last
        for now in times:
            if last >= 0 and now - last >= self.idle_ms:
                yield Row(S=S, event="idle", at=last + self.idle_ms)
                last = -1
            if last < 0:
                yield Row(S=S, event="active", at=now)
            last = max(last, now)
        if last != before:
            if before >= 0:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last + self.idle_ms)
            self._set(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else -1
        if last >= 0 and last + self.idle_ms == at:
            self._set(-1)
            yield Row(S=key[0], event="idle", at=at)

    def close(self) -> None:
        pass


def live_events(messages: DataFrame, idle: str = IDLE, watermark: str | None = None) -> DataFrame:
    """L2, L3, L4 as a stream: (S, event, at) whenever something changes, and only then; messages need S and time.

    event: ``added`` (first line of a session ever) or ``refresh`` (a later batch of lines), ``active`` or ``idle``. A session
    is active while strictly less than ``idle`` has gone by since its last line. By default that is the time at which
    lines arrive, and timers go by the clock: a running stream says ``idle`` by itself, in the batch after the
    timer, whether lines come or not. With ``watermark`` (a delay) it is the messages' own time, and timers follow the watermark.

    What is known of a session lies in RocksDB under the query's checkpoint, a long and a timer for each session, and
    survives a restart. Equal lines, late lines and lines without a time change nothing; lines without S are left out.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = messages.where("S is not null")
    if watermark:
        rows = rows.withWatermark("time", watermark)
    S = rows.schema["S"].dataType.simpleString()
    rows = rows.select("S", "time", F.unix_millis("time").alias("ms"))
    return rows.groupBy("S").transformWithState(
        ActivityProcessor(_milliseconds(idle), watermark is not None), f"S {S}, event string, at long", "Append", "EventTime" if watermark else "ProcessingTime",
    ).withColumn("at", F.timestamp_millis("at"))


def active_set(events: DataFrame) -> DataFrame:
    """(S, since) of sessions that are active after all of these events: each session's last change decides."""
    last = events.where("event in ('active', 'idle')").groupBy("S").agg(F.max(F.struct("at", F.expr("event = 'active'").alias("on"))).alias("x"))
    return last.where("x.on").select("S", F.col("x.at").alias("since"))
