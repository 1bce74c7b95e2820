import base64
import gzip
import hashlib
import random

import pytest

from qcloom.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): of equal payloads the first by id is the response."""
    out, seen = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))):
        b = (html or "").encode()
        if b in seen:
            out.append((i, len(b), digest(b), "revisit", seen[b]))
        else:
            seen[b] = i
            out.append((i, len(b), digest(b), "response", None))
    return sorted(out, key=repr)


def some_pages():
    rng = random.Random(1)
    copy = "<p>the same page</p>" * 30
    rows = [(i, f"http://h/{i}", copy) for i in range(20, 60)]
    rows += [(100 + i, "http://é/ü", "".join(rng.choice("aé日\r\n<>") for _ in range(rng.randrange(0, 90_000)))) for i in range(12)]
    rows += [(1, "u", "x WARC/1.1\r\n y" * 900), (2, "http://h/WARC/1.1", "WARC/1.1"), (3, "a b\r\nc", "WARC/1.1\r\n"), (4, None, "\r\n\r\n"), (5, "", "0\r\n\r\n" * 5000)]
    rows += [(6, "u", None), (7, "u", ""), (None, "n", "no id"), (None, "n", ""), (8, "v", "long" * 500_000)]
    return rows + [(59, "http://h/59", copy), (59, "http://h/59", copy), (59, "other", copy), (30, "http://h/30", copy), (9, "z", "twice"), (9, "z", "twice")]


@pytest.mark.parametrize("how", [{}, {"broadcast": 0}])
def test_round_trip(spark, tmp_path, how):
    rows = some_pages()
    d = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as sha", "2 as record_type", "3 as payload")
    roles = W.with_roles(d, **how)
    W.write_warc(W.records(roles), path := str(tmp_path / "a"))
    got = W.read_pages(spark, path).collect()
    assert not [r.problem for r in got if r.problem]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    html = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert html[1] == ("x WARC/1.1\r\n y" * 900).encode() and html[8] == b"long" * 500_000 and html[2] == b"WARC/1.1"
    assert W.read_warc(spark, path).where("headers['warc-type'] = 'continuation'").count() > 100


def test_small_segments_and_plain_files(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * (i * 40)) for i in range(30)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    recs = W.records(W.with_roles(d), segment_bytes=100, date="2020-01-01T00:00:00Z")
    # continuations lie in other archives than what they go on from
    W.write_warc(recs.repartition(6), path := str(tmp_path / "a"), compression="none")
    whole = W.read_pages(spark, path).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in whole) == [(i, h) for i, _, h in rows]
    twice = W.reassembled(W.read_warc(spark, path).union(W.read_warc(spark, path))).where("size(parts) > 1")
    assert twice.where("problem is not null").count() == 0 and twice.count() == len({i for i, _, h in rows if len(W.HTTP + W.chunked(h.encode())) > 100})


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert W.archived(none, str(tmp_path / "a")).count() == 0


def rec(block, **headers):
    return W.record([(k.replace("_", "-"), v) for k, v in headers.items()], block) + b"\r\n\r\n"


def test_damaged_and_foreign(spark, tmp_path):
    http, body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n", b"4;x=1\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: 1\r\n\r\n"
    app = {"Content_Type": "application/http"}
    plain = b"a\r\nWARC/1.1\r\nb WARC/1.1\r\n WARC/1.1\r\n"
    data = [
        rec(b"software: x\r\n", WARC_Type="warcinfo", WARC_Record_ID="<i>"),
        rec(plain, WARC_Type="resource", WARC_Record_ID="<1>", WARC_Payload_Digest="sha1:" + digest(plain)),
        rec(http + body, WARC_Type="response", WARC_Record_ID="<2>", **app),
        rec(http + body[:-9], WARC_Type="response", WARC_Record_ID="<3>", **app),
        rec(http + body, WARC_Type="response", WARC_Record_ID="<4>", WARC_Payload_Digest="sha1:AAAA", **app),
        rec(b"one ", WARC_Type="resource", WARC_Record_ID="<5>", WARC_Segment_Number="1"),
        rec(b"two ", WARC_Type="continuation", WARC_Record_ID="<5b>", WARC_Segment_Origin_ID="<5>", WARC_Segment_Number="2"),
        rec(b"end", WARC_Type="continuation", WARC_Record_ID="<5c>", WARC_Segment_Origin_ID="<5>", WARC_Segment_Number="3", WARC_Segment_Total_Length="11"),
        rec(b"one", WARC_Type="resource", WARC_Record_ID="<6>", WARC_Segment_Number="1"),
        rec(b"end", WARC_Type="continuation", WARC_Segment_Origin_ID="<6>", WARC_Segment_Number="3", WARC_Segment_Total_Length="6"),
        rec(b"one", WARC_Type="resource", WARC_Record_ID="<7>", WARC_Segment_Number="1"),
        rec(b"end", WARC_Type="continuation", WARC_Segment_Origin_ID="<7>", WARC_Segment_Number="2", WARC_Segment_Total_Length="7"),
        rec(b"lone", WARC_Type="continuation", WARC_Segment_Origin_ID="<8>", WARC_Segment_Number="2", WARC_Segment_Total_Length="9"),
        rec(b"open", WARC_Type="resource", WARC_Record_ID="<9>", WARC_Segment_Number="1"),
        rec(b"cut off", WARC_Type="resource", WARC_Record_ID="<10>")[:-8],
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data))  # one member a record, as archives have it
    got = {r.headers.get("warc-record-id"): r for r in W.payloads(W.reassembled(W.read_warc(spark, str(tmp_path / "a.warc.gz")))).collect()}
    assert bytes(got["<1>"].payload) == plain and bytes(got["<2>"].payload) == b"Wikipedia" and bytes(got["<5>"].payload) == b"one two end"
    assert all(got[k].problem is None for k in ("<i>", "<1>", "<2>", "<5>"))
    why = {"<3>": "broken chunks", "<4>": "other digest", "<6>": "segments missing or repeated", "<7>": "other total length", "<9>": "no last segment", "<10>": "shorter than its Content-Length", None: "no first segment"}
    assert {k: r.problem for k, r in got.items() if r.problem} == why


@pytest.mark.parametrize("data", [b"", b"a", b"WARC/1.1" * 3, b"x" * 8192, b"x" * 8190 + b"WARC/1.1\r\n" * 5])
def test_chunks(data):
    framed = W.chunked(data)
    assert W.dechunked(framed) == data and b"WARC/1.1\r\n" not in framed
    assert all(W.dechunked(framed[:k]) is None for k in range(0, len(framed), 7))
