"""Keyed state over live logs: extracts reused until their time to live has passed, and exact stress levels.

Both hold a key's events back until the watermark has passed them, so that they are worked through in the order of their
times however files and batches cut the log, and what is written never changes. A restart goes on from the state store. Events
older than the watermark are dropped. State is bounded: events that wait lie within `late` of the newest,
an extract goes when its time is over, and a stress level keeps a count for each second of its window.

A log that has ended is closed by a row of a later time without a key (see heartbeat()); what is left is written then.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.score import TTL

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REUSED = "key string, event_id long, at long, hit boolean, created_at long, payload string"
LEVELS = "key string, second long, n long, level long"


class _Held(StatefulProcessor):
    """A key's rows, held until the watermark passes them. One timer is set at a time: for what is to be done next."""

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def set_for(self) -> int | None:
        return self.timer.get()[0] if self.timer.exists() else None

    def wake(self, at: int | None, watermark: int, now: int | None = None) -> None:
        """Have handleExpiredTimer called when the watermark is beyond `at` (milliseconds). now: what the timer is set for; None if it has
        fired or there is none. Each call of the state is a message to the JVM, so that what is known isn't asked for."""
        if at is not None:
            at = max(at, watermark + 1)
            if now == at:
                return
        if now is not None:
            self.handle.deleteTimer(now)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


class Reuse(_Held):
    """The first event of a key extracts; later ones take its payload until more than their time to live has passed."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "created_at long, payload string")
        self.waiting = handle.getListState("waiting", "at long, event_id long, ttl long, payload string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        watermark = timerValues.getCurrentWatermarkInMs()  # 0: none yet
        passed = watermark * 1000 if watermark > 0 else -(1 << 63)
        rows = (r for r in rows if None not in (key[0], r.event_id, r.at, r.ttl) and r.at >= passed)
        for some in batched(rows, 1000):
            self.waiting.appendList([(r.at, r.event_id, r.ttl, r.payload) for r in some])
            least = min(r.at for r in some)
            first = least if first is None else min(first, least)
        if first is None:
            return iter(())
        now = self.set_for()
        if now is not None:
            first = min(first, now * 1000)
        self.wake(first // 1000 + 1, watermark, now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[1]))
        k = sum(x[0] < watermark * 1000 for x in held)
        ready, left = held[:k], held[k:]
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        out = []
        for at, event, ttl, payload in ready:
            hit = entry is not None and at - entry[0] <= ttl
            if not hit:
                entry = (at, payload)
            out.append(Row(key=key[0], event_id=event, at=at, hit=hit, created_at=entry[0], payload=entry[1]))
        if k:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        if entry is not None and entry[0] + self.keep < watermark * 1000:
            entry = None
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)
        due = [left[0][0] // 1000 + 1] if left else []
        due += [(entry[0] + self.keep) // 1000 + 1] if entry else []
        self.wake(min(due) if due else None, watermark)
        return iter(out)


class Stress(_Held):
    """How many events of a key there were in the last `seconds`, both ends included, for each second that had any."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle) -> None:
        super().init(handle)
        # counts of seconds in order; those before `told` have been written
        self.ring = handle.getValueState("ring", "seconds array<long>, counts array<long>, told long")

    def held(self) -> tuple[dict[int, int], int]:
        """What is kept; a key has a timer as long as it has something, so that one that has fired needs no test."""
        seconds, counts, told = self.ring.get()
        return dict(zip(seconds, counts)), told

    def hold(self, ring: dict[int, int], told: int) -> None:
        if ring:
            seconds = sorted(ring)
            self.ring.update((seconds, [ring[s] for s in seconds], told))
        else:
            self.ring.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counts: dict[int, int] = {}
        watermark = timerValues.getCurrentWatermarkInMs()
        over = watermark // 1000 if watermark > 0 else -(1 << 63)
        for r in rows:
            if key[0] is not None and r.second is not None and r.second >= over:
                counts[r.second] = counts.get(r.second, 0) + 1
        if not counts:
            return iter(())
        known = self.ring.exists()
        ring, told = self.held() if known else ({}, -(1 << 63))
        for second, n in counts.items():
            ring[second] = ring.get(second, 0) + n
        self.hold(ring, told)
        now = self.set_for() if known else None
        first = (min(counts) + 1) * 1000
        self.wake(first if now is None else min(first, now), watermark, now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        over = watermark // 1000  # all events of the seconds before this one have come
        ring, told = self.held()
        out, begin, level, due = [], 0, 0, None
        seconds = sorted(ring)
        for second in seconds:
            if second >= over:
                due = (second + 1) * 1000
                break
            level += ring[second]
            while seconds[begin] < second - self.seconds:
                level -= ring[seconds[begin]]
                begin += 1
            if second >= told:
                out.append(Row(key=key[0], second=second, n=ring[second], level=level))
        keep = {s: n for s, n in ring.items() if s >= over - self.seconds}
        self.hold(keep, over)
        if due is None and keep:
            due = (max(keep) + self.seconds + 2) * 1000
        self.wake(due, watermark)
        return iter(out)


def _counting(events: DataFrame, ts: str, *needed: Column) -> DataFrame:
    """Only the events that have all that is needed: the others, which have moved the watermark, would all be one key's, the null
    one, and so one task's. The condition is one call over the time too, as the optimizer pushes those without the time below
    the watermark."""
    return events.where(~F.array_contains(F.array(*[c.isNull() for c in (F.col(ts), *needed)]), True))


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy("key").transformWithState(processor, schema, "append", "eventtime")


def ttl_state(events: DataFrame, key: Column, payload: Column, ttl_seconds: Column, ts: str = "ts", event_id: str = "event_id", late: str = "0 seconds", longest: float = max(TTL.values())) -> DataFrame:
    """One row per event, in append mode: key, event_id, at (microseconds), hit, created_at (of the extract that is used), payload (likewise).

    Rows without a key or an id only move the watermark. Ties of time go by event_id. An extract is kept for `longest` seconds; no
    time to live may be more.
    """
    rows = _counting(events.withWatermark(ts, late), ts, key, F.col(event_id)).select(key.cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.unix_micros(ts).alias("at"), (F.least(ttl_seconds, F.lit(longest)) * 1_000_000).cast("long").alias("ttl"), payload.cast("string").alias("payload"))
    return _stateful(rows, Reuse(int(longest * 1_000_000)), REUSED)


def stress_state(events: DataFrame, key: Column, seconds: int = 300, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """One row per key and second with events, in append mode: key, second, n (events), level (events of the last `seconds`)."""
    rows = _counting(events.withWatermark(ts, late), ts, key).select(key.cast("string").alias("key"), F.unix_seconds(ts).alias("second"))
    return _stateful(rows, Stress(seconds), LEVELS)


def start(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder, each row once. The state store is RocksDB, which keyed state needs; the session's setting is put back."""
    spark = out.sparkSession
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, was)


def with_heartbeats(events: DataFrame, folder: str) -> DataFrame:
    """events and the rows that heartbeat() puts in the folder, which have a time and nothing else."""
    spark = events.sparkSession
    P = spark._jvm.org.apache.hadoop.fs.Path
    P(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(P(folder))
    beats = spark.readStream.schema("ts timestamp").parquet(folder)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name != "ts"]
    return events.unionByName(beats.select("ts", *nothing))


def heartbeat(spark: SparkSession, folder: str, ts: str) -> None:
    """Tell a log's reader that all events before `ts` have come."""
    spark.range(1).select(F.lit(ts).cast("timestamp").alias("ts")).write.mode("append").parquet(folder)
