import numpy as np
import pyarrow as pa

from qcloom.llm import quality as Q
from qcloom.llm.common import flat
from qcloom.llm.langid import held_out

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def data(spark, n=600):
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "light"]
    rows = []
    for i in range(n):
        w = list(r.choice(words, r.integers(5, 60)))
        rows.append((i, " ".join(w).upper() + "!!" if i % 5 == 0 else " ".join(w) + ".", int(i % 5 != 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], LABELS)


def test_held_out(spark):
    docs, labels = data(spark)
    m = Q.fit(docs.where(~held_out()), labels.where(~held_out()), per_class=200)
    got = {r.doc_id: r.score for r in Q.score(docs.where(held_out()), m).collect()}
    right = sum((s >= Q.CUT) == (i % 5 != 0) for i, s in got.items())
    assert len(got) > 80 and right / len(got) > 0.95 and all(0 <= s <= 1 for s in got.values())


def test_sum_of_squares():
    r = np.random.default_rng(0)
    m = Q.Machine(0.3, r.normal(size=Q.SIZE).astype(np.float32), r.normal(size=(Q.SIZE, 3)).astype(np.float32))
    x = np.zeros((1, Q.SIZE), np.float32)
    at = r.choice(Q.SIZE, 6, replace=False)
    x[0, at] = r.normal(size=6)
    pairs = sum((m.v[i] @ m.v[j]) * x[0, i] * x[0, j] for k, i in enumerate(at) for j in at[:k])
    assert abs(m.margin(x)[0] - (0.3 + x[0] @ m.w + pairs)) < 1e-3


def test_edges(spark):
    docs, labels = data(spark, 60)
    m = Q.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x"), (4, "word " * 50000), (4, "word " * 50000)], DOCS).selectExpr("*", "1 as score", "2 as t")
    got = Q.score(odd, m).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(odd.limit(0), m).count() == 0
    assert Q.Machine(0.0).score(np.zeros((1, Q.SIZE)))[0] == 0.5 and Q.fit(docs, labels.limit(0)).w is None
    ones = Q.fit(docs, labels.where("quality = 1"))
    assert ones.w is None and ones.score(np.zeros((1, Q.SIZE), np.float32))[0] > 0.9
    assert Q.fit(docs.limit(0), labels).w is None


def test_repeated_ids(spark):
    """Of an id with two texts the same one teaches, however the table is cut; so scores don't change."""
    docs, labels = data(spark, 120)
    both = docs.union(docs.selectExpr("doc_id", "concat('Other words for ', doc_id, ': ', reverse(text)) AS text"))
    new = spark.createDataFrame([(1, "alpha beta GAMMA!!")], DOCS)
    got = {Q.score(new, Q.fit(both.repartition(n), labels)).first().score for n in (1, 3, 8)}
    assert len(got) == 1


def test_whole_operator_against_brute_force(spark):
    """All pairs of features in plain loops, with a model fitted on rows that were put together here."""
    docs, labels = data(spark, 80)
    x = {r.doc_id: Q.features(*flat(pa.array([r.text], pa.large_string())))[0] for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    ids = sorted(y)
    m = Q.train(Q.Half(np.stack([x[i] for i in ids]).astype(np.float16)), np.array([y[i] for i in ids], np.float32), np.ones(len(ids), np.float32))
    got = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs.repartition(5), labels)).collect()}
    for i in ids[::9]:
        at = np.flatnonzero(x[i])
        z = float(m.bias) + sum(float(m.w[a]) * float(x[i][a]) for a in at)
        z += sum(float(m.v[a] @ m.v[b]) * float(x[i][a]) * float(x[i][b]) for k, a in enumerate(at) for b in at[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-3
