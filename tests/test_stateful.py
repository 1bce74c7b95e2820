import random

import pytest
from pyspark.sql import functions as F

from qcloom.streaming import stateful as S
from qcloom.streaming import streams

EVENTS = "event_id long, user_id long, s double, ttl long, props string"


def land(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).select("event_id", "user_id", "ttl", "props", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(path)


SCHEMA = "event_id long, user_id long, ttl long, props string, ts timestamp"


def reuse(rows):
    """What a cache does that is asked in the order of times."""
    cache, out = {}, {}
    for e, user, s, ttl, props in sorted(rows, key=lambda r: (r[2], r[0])):
        if user is None:
            continue
        hit = user in cache and s - cache[user][0] <= ttl
        if not hit:
            cache[user] = (s, props)
        out[e] = (hit, cache[user][1])
    return out


def some(n, seed=1, span=4000):
    r = random.Random(seed)
    return [(i, r.choice([None, 1, 1, 1, 2, 3, 4]), float(r.randrange(span)), r.choice([60, 60, 300]), f"p{i}") for i in range(n)]


def halves(rows):
    """In order, cut between two times."""
    rows = sorted(rows, key=lambda r: r[2])
    middle = rows[len(rows) // 2][2]
    return [[r for r in rows if r[2] < middle], [r for r in rows if r[2] >= middle]]


def run(spark, tmp_path, stream, batches, end="1970-01-05 00:00:00"):
    """Land the batches one by one, with a start of the query after each and one after the last heartbeat."""
    src, out, ck, beat = (str(tmp_path / x) for x in ("in", "out", "ck", "beat"))
    for rows in batches:
        land(spark, rows, src)
        S.start(stream(S.with_heartbeats(streams.read_landing(spark, src, SCHEMA), beat)), out, ck).awaitTermination()
    S.heartbeat(spark, beat, end)
    for _ in range(2):  # a start with nothing new adds nothing
        S.start(stream(S.with_heartbeats(streams.read_landing(spark, src, SCHEMA), beat)), out, ck).awaitTermination()
    return spark.read.parquet(out).collect()


def test_ttl_state(spark, tmp_path):
    rows = some(300)
    stream = lambda e: S.ttl_state(e, F.col("user_id"), F.col("props"), F.col("ttl"))
    got = run(spark, tmp_path, stream, halves(rows))
    want = reuse(rows)
    assert {r.event_id: (r.hit, r.payload) for r in got} == want and len(got) == len(want)
    assert any(h for h, _ in want.values()) and not all(h for h, _ in want.values())


def test_ttl_state_in_any_order_within_the_delay(spark, tmp_path):
    rows = some(120, 2, 900)  # not in order: the second batch holds events from before the first one's
    stream = lambda e: S.ttl_state(e, F.col("user_id"), F.col("props"), F.col("ttl"), late="1 hour")
    got = run(spark, tmp_path, stream, [rows[:60], rows[60:]])
    assert {r.event_id: (r.hit, r.payload) for r in got} == reuse(rows)


def test_what_is_later_than_the_delay_is_dropped(spark, tmp_path):
    first = [(1, 1, 100.0, 60, "a"), (2, 1, 5000.0, 60, "b")]
    stream = lambda e: S.ttl_state(e, F.col("user_id"), F.col("props"), F.col("ttl"), late="10 seconds")
    got = run(spark, tmp_path, stream, [first, [(3, 1, 200.0, 60, "late"), (4, 1, 4999.0, 60, "in time"), (5, 2, 5001.0, 60, "c")]])
    assert {r.event_id: (r.hit, r.payload) for r in got} == reuse([*first, (4, 1, 4999.0, 60, "in time"), (5, 2, 5001.0, 60, "c")])


@pytest.mark.parametrize("late", ["0 seconds", "2 hours"])
def test_stress_state(spark, tmp_path, late):
    rows = some(250, 3, 3000)
    stream = lambda e: S.stress_state(e, F.col("user_id"), 300, late=late)
    got = run(spark, tmp_path, stream, halves(rows) if late == "0 seconds" else [rows[:120], rows[120:]])
    want = {}
    for _, u, s, _, _ in rows:
        if u is not None:
            want[str(u), int(s)] = sum(v == u and s - 300 <= t <= s for _, v, t, _, _ in rows)
    assert {(r.key, r.second): r.level for r in got} == want and len(got) == len(want)


def test_events_without_a_key_only_move_the_watermark(spark, tmp_path, monkeypatch):
    rows = [(1, 1, 100.0, 60, "a"), (2, 1, 160.0, 60, "b"), *[(k, None, float(k), 60, "c") for k in range(3, 500)]]
    stream = lambda e: S.stress_state(e, F.col("user_id"), 300)
    got = run(spark, tmp_path / "levels", stream, halves(rows), end="1970-01-01 01:30:00")
    assert sorted(tuple(r) for r in got) == [("1", 100, 1, 1), ("1", 160, 1, 2)]
    monkeypatch.setattr(S, "_stateful", lambda rows, processor, schema: rows)  # what comes to the state: one task has all of the null key
    assert sorted(tuple(r) for r in run(spark, tmp_path / "seen", stream, halves(rows))) == [("1", 100), ("1", 160)]
    both = lambda e: S.ttl_state(e, F.col("user_id"), F.col("props"), F.lit(None).cast("long"))
    assert sorted(r.event_id for r in run(spark, tmp_path / "ttl", both, halves(rows))) == [1, 2]  # a time to live may be null: the longest
