import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from qcloom.llm import repeats as P

SCHEMA = "doc_id long, text string"


def covered(rows, span):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[p : p + span] for x in raw for p in range(len(x) - span + 1))
    out = []
    for x in raw:
        m = np.zeros(len(x) + 1, int)
        for p in range(len(x) - span + 1):
            if seen[x[p : p + span]] > 1:
                m[p] += 1
                m[p + span] -= 1
        out.append(np.cumsum(m)[:-1] > 0)
    return raw, out


def brute(rows, span=P.SPAN, n=P.PASSAGE):
    res = []
    of = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in of for i in range(len(w) - n + 1))
    for (d, _), x, c, w in zip(rows, *covered(rows, span), of):
        runs = int((np.diff(np.append(0, c.astype(int))) == 1).sum())
        said = len({k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)})
        res.append((d, len(x), int(c.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~c])).hexdigest(), said))
    return sorted(res, key=repr)


def corpus(seed, n=60, span=P.SPAN):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdefgh é\n") for _ in range(k))
    passages = [text(r.choice([span - 2, span, span + 5, 3 * span])) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randrange(0, 200))]
        for _ in range(r.choice([0, 1, 1, 2])):
            p = r.choice(passages)
            parts += [p[r.choice([0, 0, 7]) :], text(r.choice([0, 0, 30, 200]))]
        rows.append((i, "".join(parts)))
    return rows


ODD = [(900, None), (901, ""), (902, "ab" * 600), (903, "x" * 399), (904, "x" * 399), (905, "y" * 400), (906, "y" * 401), (907, "abcdefg" * 100), (908, "é" * 300), (None, "z" * 900), (909, "q" + "z" * 500)]


def answers(spark, rows, monkeypatch, **options):
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    real = P.repeats
    monkeypatch.setattr(P, "repeats", lambda docs, **given: real(docs, **(given | options)))

    class Reader:
        read = type("R", (), {"parquet": staticmethod(lambda path: d)})

    return sorted(map(tuple, P.query(Reader, "x").collect()), key=repr)


@pytest.mark.parametrize("seed,group", [(0, P.GROUP), (1, P.GROUP), (2, 1)])
def test_against_brute_force(spark, monkeypatch, seed, group):
    rows = corpus(seed) + ODD + [(950, corpus(seed)[3][1]), (950, corpus(seed)[3][1])]
    assert answers(spark, rows, monkeypatch, group=group) == brute(rows)


def test_short_span(spark, monkeypatch):
    rows = corpus(5, 50, 70)
    assert answers(spark, rows, monkeypatch, span=70) == brute(rows, 70)
    monkeypatch.undo()
    with pytest.raises(ValueError):
        P.repeats(spark.createDataFrame(rows, SCHEMA), span=10)


def test_intervals_and_solve():
    words = sorted([b"banana", b"bandana", b"band", b"can"])
    lcp = [0] + [P.common(a, b) for a, b in zip(words, words[1:])]
    assert sorted(P.intervals(lcp)) == [(0, 0, 3), (3, 0, 2), (4, 1, 2)]
    got = P.solve([b"..LLMRRxx", b"..LLMRRyy", b"zzzLMRRyy"], [0, 0, 0], [4, 4, 4], 5)
    assert {g[0] for g in got} == {0, 1, 2}


def test_clean(spark):
    p = "p" + "assage" * 80
    rows = [(1, "keep one. " + p, 490), (2, "keep two. " + p + " é", 492), (3, "own", 3), (4, p, 481), (4, p, 481), (5, None, None), (6, " ", 1)]
    d = spark.createDataFrame(rows, SCHEMA + ", n_chars long").selectExpr("*", "1 as t", "2 as sha", "3 as _text")
    got = P.clean(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.text is not None) == [(1, "keep one", 8), (2, "keep two é", 10), (3, "own", 3), (6, " ", 1)]
    assert P.clean(d.limit(0)).count() == 0


def test_all_characters_whole(spark):
    rows = [(1, "é" * 201 + "a"), (2, "b" + "é" * 201)]
    assert all("�" not in (r.text or "") for r in P.clean(spark.createDataFrame(rows, SCHEMA)).collect())
