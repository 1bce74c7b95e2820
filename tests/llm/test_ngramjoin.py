import random
import re

import pytest

from qcloom.llm import ngramjoin as N

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(n=160, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "ß,", "THE"]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 5, 20, 60, 200]))] for _ in range(12)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [r.choice(vocab)], [r.choice(vocab), r.choice(vocab)]]) or [r.choice(vocab)]
        if i % 5 == 0:
            w += passage
        rows.append((i * 3, r.choice([" ", "\n", "\t "]).join(w)))
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b"), (1004, "A\tB"), (1005, "a b c d e"), (1006, "x " * 3000), (1007, "X\n" * 2500)]


@pytest.mark.parametrize("rows_per_task,queries", [(N.GROUP_ROWS, N.QUERIES), (2, 3)])
def test_against_brute_force(spark, rows_per_task, queries):
    rows = corpus() + EDGES
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = N.jaccard_components(d, group_rows=rows_per_task, queries=queries)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_more_seeds(spark, seed):
    rows = corpus(90, seed)
    assert sorted(map(tuple, N.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


@pytest.mark.parametrize("parts", [1, 30])
def test_bounds_in_shingles(spark, parts):
    rows = corpus(120, 5)
    d = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert sorted(map(tuple, N.jaccard_components(d, group_shingles=60, query_shingles=50).collect())) == brute(rows)


def test_empty_nulls_repeats(spark):
    assert N.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f")], SCHEMA)
    assert sorted(map(str, N.jaccard_components(d).collect())) == sorted(["Row(doc_id=None, n_shingles=2, component_id=None)", "Row(doc_id=5, n_shingles=2, component_id=3)", "Row(doc_id=5, n_shingles=2, component_id=3)", "Row(doc_id=3, n_shingles=2, component_id=3)"])


def test_keep_one(spark):
    d = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", 2), (7, "other", 3), (7, "other", 3), (None, "a b c d e f", 4), (9, None, 5)], "doc_id long, text string, rep int").selectExpr("*", "1 as key", "2 as _other")
    got = N.keep_one(d)
    assert got.columns == d.columns and sorted((r.doc_id or -1, r.rep) for r in got.collect()) == [(-1, 4), (1, 2), (7, 3), (9, 5)]


def test_keep_one_of_rows_that_share_an_id(spark):
    rows = [(4, "a b c d e f", 1), (4, "A b c\nd e f", 2), (4, "quite another text of its own", 3), (4, None, 4), (4, None, 4), (5, "a b c d e f", 5)]
    got = [sorted((r.doc_id, r.text, r.rep) for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, rep int").repartition(k)).collect() if r.text) for k in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == 2 and (4, "quite another text of its own", 3) in got[0] and {r[0] for r in got[0]} == {4}
