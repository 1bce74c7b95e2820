import os

import pytest

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_against_brute_force(spark):
    import corpus_pipeline as C
    from qcloom.llm.repeats import PASSAGE

    from .test_decontaminate import brute as hits
    from .test_ngramjoin import brute as groups
    from .test_repeats_words import brute as repeats

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in C.STAGES] == ["language", "near", "repeats", "benchmark", "mix"]
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.written(stage(spark, out[-1], DIR)))
        assert out[-1].columns[: len(docs.columns)] == docs.columns
    rows = [{r.doc_id: r.text for r in d.collect()} for d in out]
    assert len(rows[1]) >= 0.98 * len(rows[0])
    assert set(rows[2]) == {d for d, _, root in groups(sorted(rows[1].items())) if d == root}
    assert {d: t or "" for d, t in rows[3].items()} == repeats(sorted(rows[2].items()), PASSAGE)  # 400 bytes, and 51 words
    for d, n, hit, _ in hits(sorted(rows[3].items()), items):
        assert (d in rows[4]) == (2 * hit <= n)
        if d in rows[4] and not hit:
            assert rows[4][d] == rows[3][d]
    assert not any(h for _, _, h, _ in hits(sorted(rows[4].items()), items))
    assert set(rows[5]) <= set(rows[4])
    by = {}
    for r in out[5].collect():
        assert r.copies >= 1 and r.taken == r.copies * r.size <= 2 * r.size and r.n_chars == len(r.text)
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert {d: t for d, t in rows[5].items()} == {d: rows[4][d] for d in rows[5]}


def test_run_is_the_stages(spark):
    import corpus_pipeline as C
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is C.run and C.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    a, b = (sorted((r.doc_id, r.copies) for r in C.run(spark, DIR).collect()) for _ in range(2))
    assert a == b and a


def test_empty(spark, tmp_path):
    import corpus_pipeline as C

    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
