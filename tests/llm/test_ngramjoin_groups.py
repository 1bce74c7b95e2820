import random

import numpy as np
import pytest

from qcloom.llm import ngramjoin as N

from .test_ngramjoin import SCHEMA, brute


def variants(n, edits, seed=7):
    """Copies of one text with so many words changed; from 12 edits on no two of them reach the similarity."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for k in r.sample(range(400), r.choice(edits)):
            w[k] = r.choice([f"x{r.randrange(10**6)}", f"b{r.randrange(400)}"])
        rows.append((i, " ".join(w)))
    return rows


def group(rows):
    sets = [x for _, x in N._each(_batch(rows))]
    tok, back, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = dict(zip(tok.tolist(), freq.tolist()))
    shared = [x[[of[t] > 1 for t in x.tolist()]] for x in sets]
    return N.Group([len(x) for x in sets], shared, [np.array([of[t] for t in x.tolist()], np.int32) for x in shared], 75)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])


def roots(m, edges):
    parent = list(range(m))
    for _ in range(m):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return parent


@pytest.mark.parametrize("edits", [[20], [1, 3, 5, 8, 10, 12, 14, 30]])
def test_copies_with_many_changes_are_not_compared_with_all_others(edits):
    rows = variants(300, edits)
    g = group(rows)
    compared, links = [], g.links
    g.links = lambda p, cand: (compared.append(len(cand)), links(p, cand))[1]
    assert roots(len(rows), N.connect(g)) == [c for _, _, c in brute(rows)]
    assert sum(compared) < 10 * len(rows)  # of 45,000 pairs


def jobs(spark, rows, **options):
    spark.sparkContext.setJobGroup(name := f"large-{len(rows)}", name)
    try:
        got = sorted(map(tuple, N.jaccard_components(spark.createDataFrame(rows, SCHEMA), **options).collect()))
    finally:
        spark.sparkContext.setJobGroup("", "")
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_a_large_group(spark):
    few, many = variants(24, [1, 3, 5, 8, 10, 12, 14]), variants(96, [1, 3, 5, 8, 10, 12, 14])
    (a, k), (b, m) = (jobs(spark, rows, group_rows=6, queries=3) for rows in (few, many))
    assert a == brute(few) and b == brute(many)
    assert m <= k + 5


def test_all_texts_are_read_once(spark):
    """Only the texts of sets that are left are read again."""
    rows = variants(20, [1, 3]) + [(50, None), (None, "a b c d e f"), (51, ""), *((k, f"only {k} has these {k} words {k}") for k in range(60, 90))]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d = spark.createDataFrame(rows, SCHEMA).repartition(3).mapInArrow(counted, SCHEMA)
    got = {r.doc_id: tuple(r) for r in N.jaccard_components(d).collect()}
    assert got == {None: (None, 2, None)} | {r[0]: r for r in brute([r for r in rows if r[0] is not None])}
    assert read.value <= 2 * len(rows)
