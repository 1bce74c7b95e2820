"""Repeats told in words: every string of so many words that occurs elsewhere goes, however many bytes it has."""

import os
import random
import re
from collections import Counter

import pytest

from qcloom.llm import repeats as P

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(rows, n, span=P.SPAN):
    """{id: text} after both cuts, found by trying all windows."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", x)] for _, x in raw]
    of = [[x[a:e] for a, e in w] for (_, x), w in zip(raw, at)]
    seen = Counter(tuple(w[i : i + n]) for w in of for i in range(len(w) - n + 1))
    runs = Counter(x[p : p + span] for _, x in raw for p in range(len(x) - span + 1))
    out = {}
    for (d, x), w, pos in zip(raw, of, at):
        gone = bytearray(len(x))
        for p in range(len(x) - span + 1):
            if runs[x[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        hit = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        for k in hit:  # with the white space up to the next word, if that goes too
            a, e = pos[k][0], pos[k + 1][0] if k + 1 in hit else pos[k][1]
            gone[a:e] = b"\1" * (e - a)
        left = bytes(c for c, g in zip(x, gone) if not g).decode(errors="ignore")
        if left.strip() or not any(gone):
            out[d] = left
    return out


def prose(r, k, letters="abcdefghijklmnopqrstuvwxyzé"):
    return [("".join(r.choice(letters) for _ in range(r.randrange(1, 9)))) for _ in range(k)]


def corpus(seed, n):
    r = random.Random(seed)
    passages = [prose(r, k) for k in (n - 1, n, n, n + 4, 2 * n)] + [["a"] * (n + 3)]
    rows = []
    for i in range(40):
        w = prose(r, r.randrange(0, 60))
        for _ in range(r.choice([0, 1, 1, 2])):
            w += r.choice(passages)[r.choice([0, 0, 2]) :] + prose(r, r.choice([0, 0, 5, 30]))
        rows.append((i, "".join(x + r.choice([" ", " ", "\n", " \t"]) for x in w)))
    return rows


@pytest.mark.parametrize("seed,group", [(0, P.GROUP), (1, 1)])
def test_against_brute_force(spark, seed, group):
    rows = corpus(seed, 51) + [(100, None), (101, ""), (102, "Short text"), (103, "Short text"), (104, corpus(seed, 51)[3][1])]
    got = P.clean(spark.createDataFrame(rows, SCHEMA).repartition(3), group=group, words=51).collect()
    assert {r.doc_id: r.text or "" for r in got} == brute(rows, 51) and len(got) == len({r.doc_id for r in got})


def test_stage_cuts_a_passage_of_55_words(spark):
    import corpus_pipeline as C

    r = random.Random(9)
    p, q = (" ".join(prose(r, k)) for k in (55, 50))
    assert len(p.encode()) < P.SPAN and len(q.encode()) < P.SPAN
    own = [" ".join(prose(r, 80)) for _ in range(8)]
    rows = [(0, f"{own[0]} {p} {own[1]}"), (1, f"{own[2]} {p} {own[3]}"), (2, f"{own[4]} {q} {own[5]}"), (3, f"{own[6]} {q} {own[7]}")]
    got = {x.doc_id: x.text for x in dict(C.STAGES)["repeats"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {0: f"{own[0]}  {own[1]}", 1: f"{own[2]}  {own[3]}", 2: rows[2][1], 3: rows[3][1]}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stage_on_the_tables(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = dict(C.STAGES)["repeats"](spark, docs, DIR).collect()
    assert {r.doc_id: r.text or "" for r in got} == brute(rows, P.PASSAGE)
