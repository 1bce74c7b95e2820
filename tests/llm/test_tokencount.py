import pytest

from qcloom.llm import tokencount as T

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"
TEXTS = [None, "", " ", "Hello, World! it's 2024's", "x<|endoftext|>y", "<|ENDOFTEXT|>", "日本語 text", "Ünï çødé ½ ² ª", "é combining", "a" * 5000, "word " * 3000, "tab\tnew\nline nbsp", "İstanbul ǅ ΑΣ", "'s't 'll''ve", "emoji 😀 🇩🇪", "\x00\x0b control"]


def expected(name, texts):
    texts = [t or "" for t in texts]
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, tmp_path, name):
    rows = list(enumerate(TEXTS)) + [(50, TEXTS[3]), (None, "null id"), (51, None)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as digest", "2 as n_tokens", "3 as t")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(d, P.path(name), str(tmp_path / "c")).collect()), key=repr)
    n = expected(name, [t for _, t in rows])
    assert got == sorted(((d, len((t or "").encode()), k, k > 2048) for (d, t), k in zip(rows, n)), key=repr)


def test_cache(spark, tmp_path):
    path, cache = P.path("word_bpe_49k.json"), str(tmp_path / "cache")
    d = spark.createDataFrame([(i, f"text number {i % 4}") for i in range(12)], SCHEMA)
    first = sorted(map(tuple, T.count_tokens(d, path, cache).collect()))
    assert spark.read.parquet(cache).count() == 4
    assert sorted(map(tuple, T.count_tokens(d, path, cache).collect())) == first and spark.read.parquet(cache).count() == 4
    more = d.union(spark.createDataFrame([(99, "something new")], SCHEMA))
    assert T.count_tokens(more, path, cache).count() == 13 and spark.read.parquet(cache).count() == 5
    T.count_tokens(d, P.path("byte_bpe_50k.json"), cache).count()
    assert spark.read.parquet(cache).count() == 9
    assert T.count_tokens(d.limit(0), path, str(tmp_path / "none")).count() == 0
