import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from qcloom.llm import resample as R
from qcloom.llm.common import flat

SCHEMA = "doc_id long, text string"


def bag(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20):
    def buckets(texts):
        n = [0] * 10000
        for t in texts:
            for f in bag(t)[1]:
                n[zlib.crc32(f.encode()) % 10000] += 1
        return n

    s, t = buckets(x for _, x in docs), buckets(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        n, f = bag(x)
        w = sum(gain[zlib.crc32(g.encode()) % 10000] for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long[: len(long) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def prose(rng, n, words):
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


def test_crc_of_runs():
    words = ["a", "é", "x" * 63, "x" * 64, "y" * 65, "z" * 66, "w" * 5000, "日本", "b", "1234567"] * 2
    texts = [" ".join(words), "", "one", "two, Three"]
    import pyarrow as pa

    buf, offs = flat(pa.array(texts, pa.large_string()))
    first, runs = R.features(buf, offs)
    for d, t in enumerate(texts):
        got = [int(b) for at, bs in runs for a, b in zip(at, bs) if first[d] <= a < first[d + 1]]
        assert got == [zlib.crc32(f.encode()) % 10000 for f in bag(t)[1]]
    assert R.shift(np.array([zlib.crc32(b"ab")], np.uint32), np.array([100_000]))[0] ^ zlib.crc32(b"q" * 100_000) == zlib.crc32(b"ab" + b"q" * 100_000)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50)] + ["Ünï", "LONG" * 40, "日本語"]
    docs = prose(rng, 400, vocab) + [(None, "w1 " * 30), (1000, None), (1001, ""), (1002, "...!"), (7, "w2 " * 25), (8, " ".join(rng.choice(vocab) for _ in range(20_000)))]
    target = [" ".join(rng.choice(vocab[:10]) for _ in range(50)), None, ""]
    d = spark.createDataFrame(docs, SCHEMA).repartition(5).selectExpr("*", "1 as score", "2 as bucket", "3 as _row", "'x' as rank")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = sorted((tuple(r) for r in R.draw(d, t, ["doc_id"], percent=30).collect()), key=repr)
    assert got == brute(docs, target, 30)
    assert got == sorted((tuple(r) for r in R.draw(d.repartition(2), t, ["doc_id"], percent=30).collect()), key=repr)
    own = R.resample(d, t, percent=30)
    assert own.columns == [*d.columns, "n_features", "weight", "score_", "rank_"]
    assert sorted(r.rank_ for r in own.collect()) == list(range(1, len([g for g in got if g[4]]) + 1))


def test_copies_fill_the_cut(spark):
    """All rows equal in text, half of them in id too: exactly as many are drawn, each rank once."""
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(3, text)] * 50 + [(i, text) for i in range(10, 60)] + [(None, text)] * 5
    d, t = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame([(text,)], "text string")
    for percent in (5, 40, 99, 100):
        got = sorted((tuple(r) for r in R.draw(d, t, ["doc_id"], percent=percent).collect()), key=repr)
        assert got == brute(docs, [text], percent)


@pytest.mark.parametrize("score,need", [([5] * 40, 7), (list(range(-20, 20)), 13), ([10**12, -(10**12), 0, 0, 3], 2), ([1], 1)])
def test_cutoff(spark, score, need):
    low = sorted(score)
    v, below = R.cutoff(spark.createDataFrame([(s,) for s in score] + [(None,)], "x long"), "x", need)
    assert v == low[need - 1] and below == sum(s < v for s in score)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(i, f"some words here {i} " * 8) for i in range(40)], SCHEMA)
    assert R.draw(none, some, ["doc_id"]).count() == 0
    rows = R.draw(some, none, ["doc_id"]).collect()
    assert len(rows) == 40 and sum(r.rank is not None for r in rows) == 2
    assert R.draw(some.limit(3), none, ["doc_id"]).where("rank is not null").count() == 0
