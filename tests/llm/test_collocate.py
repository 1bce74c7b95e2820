import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qcloom.llm import collocate as C

SCHEMA = "doc_id long, text string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=2000, run=3):
    n, f = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, run + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = {}
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(a, inside.get((lang, w[i : i + k]), 0))
    out = {}
    for (lang, w), a in cands.items():
        if 100 * inside.get((lang, w), 0) >= 50 * a and (lang, w) in inside:
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    rows = []
    for lang, x in out.items():
        for k, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1):
            rows.append((lang, k, p.decode(), -a, l, r, n[lang], -s))
    return sorted(rows)


def some_docs(seed=3, n=150):
    rng = random.Random(seed)
    vocab = ["The", "cat", "sat", "ün", "日本", "a\x00b", "x y", "don't", "ONE", "two"]
    docs = []
    for i in range(n):
        t = "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\r\n"]) for _ in range(rng.randrange(0, 60)))
        docs.append((i, t, rng.choice(["de", "en", None, "und", "en"])))
    return [*docs, (None, None, "en"), (1000, "", None), (1001, " ,.; \t", "xx"), (1002, "word" * 3000 + " " + "far away " * 4000, "en"), (1003, "red fox " * 9, "de"), (3, docs[3][1], docs[3][2])]


@pytest.mark.parametrize("how", [{}, {"flush": 50, "part_mass": 300}, {"filter_bytes": 1, "flush": 700}])
def test_against_brute_force(spark, how):
    docs = some_docs()
    d = spark.createDataFrame(docs, SCHEMA).repartition(5).selectExpr("*", "1 as phrase", "2 as n", "3 as _text")
    assert sorted(map(tuple, C.collocations(d, **how).collect())) == brute(docs)


def test_ranks_are_cut(spark):
    docs = some_docs(4)
    d = spark.createDataFrame(docs, SCHEMA)
    assert sorted(map(tuple, C.collocations(d, top=7, least=5, run=4).collect())) == brute(docs, 5, 7, 4)


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("x", 1, "a", big), ("x", 1, "b", big + 1), ("x", 2, "a b", big - 7)]
    r = C.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).first()
    assert r.score == 10**6 * (big - 7) ** 2 // (big * (big + 1))


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=80), max_size=12), st.integers(2, 12))
def test_no_frequent_item_is_lost(lists, least):
    """However the stream is cut into local counts, what occurs `least` times survives, and no counter is too high."""
    total = Counter(x for one in lists for x in one)
    counts = [np.unique(np.array(x, np.uint32), return_counts=True) for x in lists]
    capacity = sum(total.values()) // least + 1
    h, n, off = C.merge(((a, b.astype(np.int64)) for a, b in counts), capacity)
    assert len(h) <= capacity and off < least
    got = dict(zip(h.tolist(), n.tolist()))
    for x, f in total.items():
        assert f - off <= got.get(x, 0) <= f
        assert f < least or got[x] + off >= least
