import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from qcloom.llm import langid as L

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"en": "the of and thing that with from have", "de": "der die und nicht schön für über ein", "fr": "le été et pas être où très une", "es": "el niño y muy está donde también una"}


def docs(spark, n=400):
    r = np.random.default_rng(0)
    langs = list(WORDS)
    return spark.createDataFrame([(i, " ".join(r.choice(WORDS[langs[i % 4]].split(), r.integers(3, 40))), langs[i % 4]) for i in range(n)], SCHEMA)


def test_held_out_accuracy(spark):
    d = docs(spark)
    m = L.fit(d.where(~L.held_out()))
    got = L.predict(d, m, ["doc_id", "lang"]).withColumn("held_out", L.held_out()).where("held_out")
    assert 50 < got.count() < 120 and got.where("lang = lang_pred").count() / got.count() > 0.97
    assert got.where("score < 0 or score > 1").count() == 0
    upper = d.withColumn("text", F.upper("text"))
    assert L.predict(upper, m, ["lang"]).where("lang <> lang_pred").count() < 20


def test_edges(spark):
    m = L.fit(docs(spark))
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "123 !!", "en"), (4, "a", "en"), (5, "the of " * 50000, "en"), (6, "日本", None)], SCHEMA)
    got = {r.doc_id: r for r in L.predict(odd, m, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert got[4].lang_pred in WORDS and got[5].lang_pred == "en" and got[6].lang_pred in WORDS
    none = L.fit(odd.where("lang is null"))
    assert none.langs == [] and L.predict(odd, none, ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    one = L.fit(odd.where("doc_id = 5"))
    assert L.predict(odd, one, ["doc_id"]).where("doc_id = 5").first().lang_pred == "en"
    assert L.predict(odd.limit(0), m, ["doc_id"]).count() == 0


def test_keep_known(spark):
    d = docs(spark, 40).union(spark.createDataFrame([(900, None, "en"), (901, "42", "en"), (0, "the of and", "en")], SCHEMA)).selectExpr("*", "1 as score", "2 as _lang", "3 as ambiguous")
    got = L.keep_known(d, L.fit(docs(spark)))
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == set(range(40)) and got.where("doc_id = 0").count() == 2


def test_codewords():
    for k in (1, 2, 4, 6, 7, 40):
        c = L.codewords(k)
        assert c.shape[0] == k and len({tuple(r) for r in c.tolist()}) == k
    c = L.codewords(40)
    assert min((c[i] != c[j]).sum() for i in range(40) for j in range(i)) >= 10


def brute(train, texts):
    """[(language, score)] by the definition, one n-gram at a time."""
    import math

    def grams(text):
        low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
        low = re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: bytes([0xC3, m[1][0] + 32]), low)
        out = []
        for i in range(len(low) - 2):
            a, b, c = low[i : i + 3]
            if not (a == b == 32 or b == c == 32):
                out.append(((((a * 65599 * 65599 + b * 65599 + c) & 0xFFFFFFFF) * 2654435761) & 0xFFFFFFFF) >> 19)
        return out

    langs = sorted({x for _, x in train})
    count = {x: Counter() for x in langs}
    for t, x in train:
        count[x].update(grams(t))
    share = {x: [(count[x][g] + 0.5) / (count[x].total() + 0.5 * L.BUCKETS) for g in range(L.BUCKETS)] for x in langs}
    code = L.codewords(len(langs)).tolist()
    w, weight = [], []
    for k in range(len(code[0])):
        one, two = ([share[x] for x, c in zip(langs, code) if c[k] * s > 0] for s in (1, -1))
        one, two = ([sum(v) / len(v) for v in zip(*rows)] if rows else [1 / L.BUCKETS] * L.BUCKETS for rows in (one, two))
        w.append([math.log(a / b) for a, b in zip(one, two)])
        weight.append(max(1e-6, sum((a - b) * r for a, b, r in zip(one, two, w[-1]))))
    res = []
    for t in texts:
        g = grams(t)
        margin = [L.SCALE * sum(x[i] for i in g) / max(len(g), 1) for x in w]
        loss = [sum(v * math.log1p(math.exp(-m * c)) for v, m, c in zip(weight, margin, word)) / sum(weight) for word in code]
        p = [math.exp(-L.SCALE * (x - min(loss))) for x in loss]
        best = max(range(len(langs)), key=lambda k: p[k])
        res.append((langs[best], p[best] / sum(p)))
    return res


def test_decoder_against_brute_force(spark):
    for k, n in ((4, 60), (7, 70)):
        r = np.random.default_rng(k)
        alphabet = {f"l{i}": ["".join(r.choice(list("abcdefghijkéÜñ"), r.integers(2, 6))) for _ in range(12)] for i in range(k)}
        rows = [(i, " ".join(r.choice(alphabet[f"l{i % k}"], r.integers(1, 9))) + r.choice(["", "!  ", " 12"]), f"l{i % k}") for i in range(n)]
        d = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {x.doc_id: x for x in L.predict(d, L.fit(d.where("doc_id % 3 > 0")), ["doc_id"]).collect()}
        for (i, t, _), (lang, score) in zip(rows, brute([(t, x) for i, t, x in rows if i % 3], [t for _, t, _ in rows])):
            assert abs(got[i].score - score) < 1e-4 and (got[i].lang_pred == lang or score < 0.52)
            assert got[i].ambiguous == (got[i].score < L.AMBIGUOUS)


def test_ties_go_to_the_first_language(spark):
    d = spark.createDataFrame([(1, "aaa bbb", "zz"), (2, "aaa bbb", "mm")], SCHEMA)
    assert {r.lang_pred for r in L.predict(d, L.fit(d), ["doc_id"]).collect()} == {"mm"}


def test_many_languages(spark):
    n = L.CHOOSE + 200
    d = spark.range(n).selectExpr("id as doc_id", "concat('word', hex(id), ' ', hex(id * 7919), ' ', hex(id * 104729)) as text", "concat('lang', id) as lang")
    m = L.fit(d)
    # one short text a language: far above chance is all that can be asked
    assert len(m.langs) == n and len(np.unique(m.code, axis=0)) == n and L.predict(d, m, ["lang"]).where("lang = lang_pred").count() > 0.1 * n
