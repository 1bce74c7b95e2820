import pytest
from pyspark.sql import functions as F

from qcloom.operators import worklist as W

UC = ["UCECWJfpmSWeaZ2fbb0rlq_g", "UCabcdefghijklmnopqrstuv", "UC0123456789012345678901"]


def parse(spark, text, default=None):
    lines = W.read_lines(spark.createDataFrame([(text,)], "text string"))
    items, rejects = W.parse_items(lines, default)
    rows = [(r.id, r.type, r.label) for r in items.orderBy("line_no", "pos").collect()]
    return rows, [r.line for r in rejects.collect()], W.parse_report(items, rejects).first()


CASES = [
    (f"{UC[0]},channel,US - Noo, dah", "channel", [(UC[0], "channel", "US - Noo, dah")], 0),
    (f"{UC[0]},channel\r\n{UC[0]},channel,late", "channel", [(UC[0], "channel", "late")], 0),
    ("US - Noodah05", "channel", [], 1),
    ("channel", "channel", [], 1),
    ("@Noodah05\nhttps://www.youtube.com/@Noodah05", None, [("@Noodah05", "channel", None)], 0),
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "channel", [("dQw4w9WgXcQ", "video", None)], 0),
    ("https://youtu.be/dQw4w9WgXcQ\nyoutube.com/shorts/abc_def-123", None, [("dQw4w9WgXcQ", "video", None), ("abc_def-123", "video", None)], 0),
    ("dQw4w9WgXcQ", None, [("dQw4w9WgXcQ", "video", None)], 0),
    ("dQw4w9WgXcQ", "channel", [("dQw4w9WgXcQ", "channel", None)], 0),
    (f"id,type,label\n{UC[1]},ch,x", None, [(UC[1], "channel", "x")], 0),
    (", ".join(UC), "channel", [(u, "channel", None) for u in UC], 0),
    ("https://youtu.be/aaaaaaaaaaa https://youtu.be/bbbbbbbbbbb", None, [("aaaaaaaaaaa", "video", None)], 0),
    ("mail me@gmail.com", None, [("@gmail.com", "channel", None)], 0),
    ("more information", None, [("information", "video", None)], 0),
    ("", None, [], 0),
]


@pytest.mark.parametrize("text,default,want,rejected", CASES)
def test_parse_items(spark, text, default, want, rejected):
    rows, rejects, report = parse(spark, text, default)
    assert rows == want and len(rejects) == rejected == report.unrecognized


def test_dedupe_counts(spark):
    _, _, report = parse(spark, f"{UC[0]}\n{UC[0]}\n{UC[1]}")
    assert (report.channels, report.videos, report.deduped) == (2, 0, 1)


def test_detect_and_rows(spark):
    rows = spark.createDataFrame([(0, "a", UC[0]), (1, "b", UC[0]), (2, "c", "just a name")], "line_no long, name string, `channel url` string")
    assert W.detect_id_column(rows) == "channel url"
    items, rejects = W.items_from_rows(rows, "channel url", label_col="name", default_type="channel")
    assert [(r.id, r.label, r.seen) for r in items.collect()] == [(UC[0], "a", 2)] and rejects.count() == 1
    assert W.detect_id_column(spark.createDataFrame([(0, "a", "hello")], "line_no long, name string, notes string")) is None
    raw, _ = W.items_from_rows(rows, "name", trust_raw=True, default_type="channel")
    assert {r.id for r in raw.collect()} == {"a", "b", "c"}


def test_fingerprint(spark):
    make = lambda rows: W.fingerprint(spark.createDataFrame(rows, "id string, type string")).first().fingerprint
    assert make([("UC2", "channel"), ("UC1", "channel"), ("UC1", "channel")]) == "63fef276d1170a04"
    assert make([("X1", "video")]) != make([("X1", "channel")])


def test_base_url(spark):
    d = spark.createDataFrame([(UC[0],), ("@a",), ("b",)], "id string").select(W.channel_base_url(F.col("id")).alias("u"))
    assert [r.u for r in d.collect()] == [f"https://www.youtube.com/channel/{UC[0]}", "https://www.youtube.com/@a", "https://www.youtube.com/@b"]


def test_repartition_changes_nothing(spark):
    text = "\n".join(f"{UC[i % 3]},channel,l{i}" for i in range(20))
    lines = W.read_lines(spark.createDataFrame([(text,)], "text string"))
    a, b = (sorted(map(tuple, W.parse_items(x)[0].collect())) for x in (lines, lines.repartition(7)))
    assert a == b


def test_fingerprint_streams_through_the_digest(spark):
    import hashlib

    d = spark.range(20_000).selectExpr("concat('i', id % 15000) AS id", "CASE WHEN id % 3 = 0 THEN 'video' ELSE 'channel' END AS type", "id % 4 AS g").repartition(7)
    rows = {(r.g, f"{r.type}:{r.id}") for r in d.collect()}
    mark = lambda keys: hashlib.sha1("\n".join(sorted(keys)).encode()).hexdigest()[:16]
    all_keys = {k for _, k in rows}
    got = W.fingerprint(d).collect()
    assert [(r.fingerprint, r.total_items) for r in got] == [(mark(all_keys), len(all_keys))]
    by = {r.g: (r.fingerprint, r.total_items) for r in W.fingerprint(d, "g").collect()}
    assert by == {g: (mark(k for h, k in rows if h == g), sum(h == g for h, _ in rows)) for g in range(4)}
    assert W.fingerprint(d.limit(0)).first().fingerprint == hashlib.sha1(b"").hexdigest()[:16] and W.fingerprint(d.limit(0), "g").count() == 0
