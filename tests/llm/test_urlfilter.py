import duckdb
import pandas as pd
import pytest

from qcloom.llm import urlfilter as U

SCHEMA = "page_id long, url string"
URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "https://a.example.org/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/9", "http://com/de/", "http://x.com/de/9/a/b/c/d/e/f/g",
    "http://notcom/fr/1", "http://h.net/a/1", "http://h.net/a/2/", "http://h.net//a//3", "http://h.net/é/ü?q=/x", "http://H.NET/de/77#f", "http://u:p@h.net:80/p", "x://y://z/w",
]


def test_split_and_rules(spark):
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(list(enumerate(URLS)), SCHEMA)).collect()}
    assert [(got[i].host, got[i].path) for i in range(4)] == [("", "")] * 4 and got[0].rule is None
    assert (got[4].host, got[4].path, got[4].rule) == ("example.org", "", None)
    assert [got[i].rule for i in (5, 6, 7, 8, 9, 11)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None]
    assert [got[i].verdict for i in (5, 6, 7, 8, 9)] == ["block", "block", "allow", "allow", "block"]
    assert (got[18].host, got[18].path) == ("y:", "//z/w") and got[17].host == "u:p@h.net:80"
    assert all(r.verdict in ("allow", "block") and 0 <= (r.score or 0) <= 1 for r in got.values())


@pytest.mark.parametrize("bound", [U.BROADCAST_BYTES, 0])
def test_against_sql(spark, monkeypatch, bound):
    monkeypatch.setattr(U, "BROADCAST_BYTES", bound)
    rows = list(enumerate(URLS)) + [(100 + i, f"http://h{i % 3}.{'com' if i % 2 else 'net'}/{['de', 'en', 'fr', 'x1', f'w{chr(97 + i % 26)}'][i % 5]}/{i % 40}/{'page' if i % 7 else i}") for i in range(400)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
    want = sorted(con.execute(U.SQL).fetchall(), key=repr)
    got = U.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("page_id", "host", "path", "rule", "verdict", "template")
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_very_long_url(spark):
    path = "/a" * 200_000
    r = U.judge(spark.createDataFrame([(1, f"http://H.net{path}?q"), (2, "http://h.net/" + "9" * 300_000)], SCHEMA)).orderBy("page_id").collect()
    assert (r[0].host, r[0].path, r[0].template) == ("h.net", path, "/a" * 6 + "/**") and len(r[1].path) == 300_001 and r[1].template == "/*"


def test_edges(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    d = spark.createDataFrame([(1, "http://q.net/a"), (1, "http://q.net/a"), (None, None)], SCHEMA).selectExpr("*", "1 as host", "2 as score", "3 as n")
    assert U.judge(d, rules=[]).count() == 3
