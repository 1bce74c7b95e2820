import duckdb
import pandas as pd
import pytest

from qcloom.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def frame(spark, n=400, sources=("a", "b", None, "c", "é")):
    rows = [(i, " ".join(["w"] * (1 + (i * 37) % 50)) if i % 17 else ("" if i % 2 else None), sources[0] if i % 3 == 0 else sources[i % len(sources)]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_against_sql(spark):
    d = frame(spark)
    con = duckdb.connect()
    pdf = pd.DataFrame(d.collect(), columns=["doc_id", "text", "source"])
    con.register("documents", pdf)
    want = sorted(con.execute(M.SQL).fetchall())
    got = sorted(tuple(r) for r in M.mix(d).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))


def test_targets_and_copies(spark):
    d = frame(spark, 3000)
    rows = M.mix(d).collect()
    by = {}
    for r in rows:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size <= 2 * r.size
        t = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0] += r.taken
        t[1] += r.size
    assert sum(t[2] for t in by.values()) == pytest.approx(1.5 * sum(t[1] for t in by.values()))
    for taken, size, target, source_size in by.values():
        assert size == source_size and target <= 2 * size + 1e-6 and abs(taken - target) <= 50
    again = {(r.doc_id, r.copies) for r in M.mix(d.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: i % 2])
def test_rows_of_one_id_draw_apart(spark, monkeypatch, ids):
    """Null ids, and many rows of an id, still come near the target; so they do where plans are joined by shuffle."""
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    rows = [(ids(i), f"t{i} " + "w " * (i % 9), "a" if i % 3 else "b") for i in range(3000)] + [(7, "long " * 2000, "a")]
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        size, most = (5, 1000) if s == "a" else (4, 5)  # a size that many rows have, and half of the largest one
        assert len({r.copies for r in mine if r.size == size}) == (2 if mine[0].target % mine[0].source_size else 1)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= most


def test_edges(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    r = M.mix(spark.createDataFrame([(1, None, None), (2, "", "x")], SCHEMA)).collect()
    assert [(x.size, x.target, x.taken) for x in r] == [(0, 0.0, 0)] * 2
    twice = spark.createDataFrame([(1, "a b", "x")] * 2 + [(None, "c", "x")], SCHEMA)
    assert M.mix(twice).count() == 3


def test_whole_rows_keep_columns(spark):
    d = frame(spark, 300).withColumnRenamed("doc_id", "doc_id")
    d = d.selectExpr("*", "1 as size", "'x' as q", "2 as v", "3 as source_size", "named_struct('a', 1) as row")
    got = M.mix(d, whole_rows=True)
    assert got.columns == [*d.columns, "size_", "source_size_", "target", "copies", "taken"]
    plain = {r.doc_id: r.copies for r in M.mix(d).collect() if r.copies}
    assert {r.doc_id: r.copies for r in got.collect()} == plain
