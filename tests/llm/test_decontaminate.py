import random
import re

import pytest

from qcloom.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(len(w), window)
        for p in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in windows:
                    hit |= set(range(p, p + k))
                    its |= windows[g]
        out.append((d, len(w), len(hit), sorted(its)))
    return sorted(out, key=repr)


def corpus(seed=0):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(40)] + ["é", "x1", "THE"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(v) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 25]))) for i in range(25)] + [(100, None), (101, "..."), (102, text(30)), (103, None)]
    items += [(104, items[3][1]), (105, items[-2][1] or "a b")]
    docs = []
    for i in range(60):
        parts = [text(r.randrange(0, 40)) for _ in range(3)]
        k = r.choice(items)[1] or ""
        w = k.split(" ")
        parts.insert(1, " ".join(w[r.randrange(0, 2) : len(w) - r.randrange(0, 2)]).upper() if i % 2 else k)
        docs.append((i, " ".join(parts)))
    return docs + [(200, None), (201, ""), (202, "!?"), (203, items[5][1]), (203, items[5][1])], items


@pytest.mark.parametrize("limit,seed", [(D.AUTOMATON_WORDS, 0), (160, 0), (D.AUTOMATON_WORDS, 1), (60, 1)])
def test_against_brute_force(spark, limit, seed):
    docs, items = corpus(seed)
    got = D.scan(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), ["doc_id"], automaton_words=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == brute(docs, items)


@pytest.mark.parametrize("chain_bytes", [D.CHAIN_BYTES, 1])
def test_one_id_and_one_long_item_are_dealt_out(spark, monkeypatch, chain_bytes):
    """Rows of a single id make several automata, and an item longer than one goes in pieces; nothing is lost."""
    monkeypatch.setattr(D, "CHAIN_BYTES", chain_bytes)  # with 1, one automaton at a time
    r = random.Random(3)
    text = lambda n: " ".join(f"v{r.randrange(60)}" for _ in range(n))
    items = [(1, text(300)), (1, text(30)), (1, text(4)), (None, text(80))]
    w = items[0][1].split(" ")
    docs = [(k, text(5) + " " + " ".join(w[k : k + 12]) + " " + text(5)) for k in range(0, 288, 3)] + [(1000, items[0][1]), (1001, items[2][1].upper())]
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    pieces = D._pieces(it, "item_id", "text", 10, 40).collect()
    assert max(p.n for p in pieces) == 40 and min(p.n for p in pieces if p.n != 4) >= 10
    assert len(list(D._packed(it, "item_id", "text", 10, 160))) > D.CHAIN
    got = D.scan(df, it, ["doc_id"], automaton_words=160).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == brute(docs, items)


def test_clean(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, f"before one two. {item} after three four five six seven eight nine ten eleven twelve."), (2, item), (3, "nothing here"), (4, None)]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "cast(length(text) as long) as n_chars", "1 as _spans", "2 as items")
    got = D.clean(d, spark.createDataFrame([(1, item)], ITEMS))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.columns == d.columns and set(rows) == {1, 3, 4} and rows[1].text == "before one two. after three four five six seven eight nine ten eleven twelve." and rows[1].n_chars == len(rows[1].text) and rows[4].text is None


def test_edges(spark):
    items = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    assert tuple(D.scan(docs, items, ["doc_id"]).first())[:4] == (1, 2, 0, 0)
    assert D.scan(docs.limit(0), items, ["doc_id"]).count() == 0
    long = "a b c d e f g h i j " * 20000
    r = D.scan(spark.createDataFrame([(1, long)], DOCS), spark.createDataFrame([(7, long[:200])], ITEMS), ["doc_id"]).first()
    assert (r.n_words, r.n_hit, r.longest, list(r["items"])) == (200000, 200000, 100, ["7"])
