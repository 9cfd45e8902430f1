"""Live activity: events of sessions by the clock and by the messages' own time, over restarts."""

import os
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from talkweave.streaming import activity, live


class Handle:
    """Stands for the state store: one value and a set of timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def played(gaps, polled=True):
    """Events of one session whose lines come after these gaps (ms); polled: batches run between, so timers are seen when they are due."""
    h, p, now, out = Handle(), activity.ActivityProcessor(30_000, False), 0, []
    p.init(h)
    for gap in [0, *gaps, None]:
        for t in sorted(t for t in h.timers if polled and (gap is None or t < now + gap)):
            h.timers.discard(t)
            out += [(r.event, r.at) for r in p.handleExpiredTimer(("s",), Clock(t), Clock(t))]
        if gap is not None:
            now += gap
            out += [(r.event, r.at) for r in p.handleInputRows(("s",), iter([Row(S="s", ms=None)]), Clock(now))]
    return [e for e in out if e[0] in ("active", "idle")], [e[0] for e in out if e[0] in ("added", "refresh")]


def test_gaps_of_29_30_and_31_seconds():
    for polled in (True, False):
        end = lambda t: [("idle", t + 30_000)] if polled else []
        assert played([29_000], polled) == ([("active", 0), *end(29_000)], ["added", "refresh"])
        assert played([30_000], polled) == ([("active", 0), ("idle", 30_000), ("active", 30_000), *end(30_000)], ["added", "refresh"])
        assert played([31_000], polled) == ([("active", 0), ("idle", 30_000), ("active", 31_000), *end(31_000)], ["added", "refresh"])
    assert played([10_000, 25_000, 29_999]) == ([("active", 0), ("idle", 94_999)], ["added", "refresh", "refresh", "refresh"])


def landing(folder, name, rows):
    (folder / "tmp").mkdir(exist_ok=True)
    (folder / "in").mkdir(exist_ok=True)
    (folder / "tmp" / name).write_text("\n".join('{"S": %s, "t": %s}' % (f'"{s}"' if s else "null", "null" if t is None else t) for s, t in rows))
    os.rename(folder / "tmp" / name, folder / "in" / f"{name}.json")


def messages(spark, folder):
    rows = spark.readStream.schema("S string, t long").json(str(folder / "in"))
    return rows.select("S", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("time"), F.lit("x").alias("event"))


def running(df, folder):
    return df.writeStream.format("parquet").option("checkpointLocation", str(folder / "cp")).option("path", str(folder / "out")).trigger(processingTime="200 milliseconds").start()


def events(spark, folder):
    if not any((folder / "out").glob("*.parquet")):
        return []
    at = F.unix_millis("at") / 1000 - 1_700_000_000
    return sorted((r.at, r.event, r.S) for r in spark.read.schema("S string, event string, at timestamp").parquet(str(folder / "out")).select(at.alias("at"), "event", "S").collect())


def test_stream_by_event_time_goes_on_after_a_restart(spark, tmp_path):
    landing(tmp_path, "1", [("a", 0), ("a", 29), ("b", 0), (None, 3), ("d", None)])
    start = lambda: running(activity.live_events(messages(spark, tmp_path), watermark="10 seconds"), tmp_path)
    q = start()
    q.processAllAvailable()
    q.stop()
    first = [(0, "active", "a"), (0, "active", "b"), (0, "added", "a"), (0, "added", "b")]
    assert events(spark, tmp_path) == first
    q = start()  # state, timers and what was said before are found again
    landing(tmp_path, "2", [("a", 60), ("b", 29), ("b", 31)])
    q.processAllAvailable()
    landing(tmp_path, "3", [("c", 200)])
    q.processAllAvailable()
    q.stop()
    found = events(spark, tmp_path)
    changes = [e for e in found if e[1] in ("active", "idle") and e[2] != "c"]
    assert changes == [(0, "active", "a"), (0, "active", "b"), (59, "idle", "a"), (60, "active", "a"), (61, "idle", "b"), (90, "idle", "a")]
    assert [e for e in found if e[1] == "added"] == [(0, "added", "a"), (0, "added", "b"), (200, "added", "c")]
    log = spark.read.parquet(str(tmp_path / "out"))
    assert [r.S for r in activity.active_set(log).collect()] == ["c"] and activity.active_set(log.limit(0)).count() == 0


def test_stream_by_the_clock_says_idle_by_itself(spark, tmp_path):
    landing(tmp_path, "1", [("a", 0), ("b", 5)])
    start = lambda: running(activity.live_events(messages(spark, tmp_path), "1 second"), tmp_path)

    def until(n, q):
        end = time.time() + 60
        while time.time() < end and len(events(spark, tmp_path)) < n:
            time.sleep(0.3)
        time.sleep(0.5)
        q.stop()
        return [(e, s) for _, e, s in events(spark, tmp_path)]

    assert sorted(until(6, start())) == sorted((e, s) for e in ("added", "active", "idle") for s in "ab")
    landing(tmp_path, "2", [("a", 1)])
    again = until(9, start())
    assert sorted(again)[2:] and sorted(again[6:]) == [("active", "a"), ("idle", "a"), ("refresh", "a")]


def test_new_sessions_of_a_stream_come_once(spark, tmp_path):
    landing(tmp_path, "1", [("a", 0), ("a", 900)])
    q = running(live.new_sessions(messages(spark, tmp_path)), tmp_path)
    landing(tmp_path, "2", [("a", 90_000), ("b", 1)])
    end = time.time() + 60
    seen = []
    while time.time() < end and len(seen) < 2:
        if any((tmp_path / "out").glob("*.parquet")):
            seen = sorted(r.S for r in spark.read.schema("S string").parquet(str(tmp_path / "out")).collect())
        time.sleep(0.3)
    q.stop()
    assert seen == ["a", "b"]
