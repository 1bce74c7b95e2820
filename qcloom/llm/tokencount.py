"""Token counts through a digest cache.

A stored count belongs to (digest of the content, digest of the tokenizer). Documents are reduced to digests, the
distinct digests are joined to the cache table, only one text of each digest that misses is encoded, and its count
is appended to the cache; then all documents join their digests' counts. Copies are encoded once, and a second run
over the same content encodes nothing. The cache is a Parquet folder that only grows; rows that two runs append for
one key agree, so that readers take either.

The content's normal form is the text itself with null read as empty: anything stronger (case, white space) would
join texts that a tokenizer may count differently, such as those with special strings.

Encoding a text: words recur, so for a "tokenizers" file that drops white space, a text's count is the sum of its words'
counts. New words are encoded by the library, the others are in a bounded memo of the Python worker. Texts with special
strings, or with characters beyond the plain Latin ones where Unicode tables of two libraries might differ, are
encoded whole by the library instead, and so is everything for other kinds of files.

Defined cases: null and empty texts have 0 bytes and 0 tokens; very long texts are encoded whole; an empty table
gives no rows; repeated rows each get their count; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import cut, scratch

LIMIT = 2048
MEMO = 500_000  # words that a worker remembers, then forgets to begin anew
PLAIN = r"[\t\n\r -~¡-ÿŒœŠšŸŽž–—‘-„…€]*"  # texts whose pieces are cut here


def digest_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens as the tokenizer file's own library does, without added special tokens."""

    def __init__(self, path: str, data: bytes) -> None:
        self.piece = None
        self.memo: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.whole = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            return
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = t = Tokenizer.from_buffer(data)
        self.whole = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(data)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = (first.get("pattern") or {}).get("Regex") or ""
        normal = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        plain = [x.get("type") for x in normal if x != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
        cut_up = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        # words that white space parts are counted one by one if no piece holds white space and lower() is all that is normalised
        if cut_up and plain == ["NFC", "Lowercase"] and not regex.search(pattern, " \t\n\r"):
            self.piece = regex.compile(pattern).findall
            self.plain = regex.compile(PLAIN).fullmatch
            self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec.get("added_tokens") or []) or r"(?!)").search

    def learn(self, new: list[str]) -> None:
        """Remember the counts of new words: their new pieces are encoded in one text, parted by spaces."""
        memo, pieces = self.memo, [[w] if w.isalpha() else self.piece(w) for w in new]
        fresh = list({p for ps in pieces for p in ps}.difference(memo))
        if fresh:
            counts = np.bincount(np.array(self.library.encode(" ".join(fresh), add_special_tokens=False).word_ids, np.int64), minlength=len(fresh))
            memo.update(zip(fresh, counts.tolist() if len(counts) == len(fresh) else self.whole(fresh)))
        memo.update(zip(new, [sum(map(memo.__getitem__, ps)) for ps in pieces]))

    def __call__(self, texts: list[str]) -> list[int]:
        if self.piece is None:
            return self.whole(texts)
        out: list[int] = [0] * len(texts)
        odd = [i for i, x in enumerate(texts) if not self.plain(x) or self.special(x)]
        for i, n in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = n
        rest = sorted(set(range(len(texts))) - set(odd))
        cut_up = [texts[i].lower().split() for i in rest]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*cut_up).difference(self.memo))
        for lo in range(0, len(new), 10_000):
            self.learn(new[lo : lo + 10_000])
        get = self.memo.__getitem__
        for i, ws in zip(rest, cut_up):
            out[i] = sum(map(get, ws))
        return out


_counters: dict[str, Counter] = {}


def counter(version: str, path: str, data: bytes) -> Counter:
    """This worker's counter for the tokenizer, with the words that it remembers from tasks before."""
    if version not in _counters:
        _counters.clear()
        _counters[version] = Counter(path, data)
    return _counters[version]


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. New counts are appended to cache_path."""
    spark = docs.sparkSession
    version = digest_of(tokenizer_path)
    with open(tokenizer_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary file, some MB whatever the corpus
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    slim = cut(rows.select("doc_id", "digest", "n_bytes"))
    schema = "digest binary, tokenizer string, n_tokens long"
    known = read_cache(spark, cache_path, schema).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    misses = slim.select("digest").distinct().join(known, "digest", "left_anti")
    # one text of each missing digest: the texts themselves are dealt out once, packed by digest
    texts = rows.select("digest", "t").mapInArrow(_own_copies(), "digest binary, z binary").join(misses, "digest", "left_semi").dropDuplicates(["digest"])
    fresh_counts = texts.mapInArrow(_encoder(version, tokenizer_path, file), "digest binary, n_tokens long")
    fresh_counts.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    stored = read_cache(spark, cache_path, schema).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    # cut, so that one digest with many rows (the empty text, say) is a skewed join that AQE can split, not the end of an aggregation
    return slim.join(cut(stored), "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def read_cache(spark, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _own_copies():
    """Pack the texts; copies inside one task are passed on once."""

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for b in batches:
            d, t = b.column(0).to_pylist(), b.column(1)
            keep = [i for i, x in enumerate(d) if not (x in seen or seen.add(x))]
            if len(seen) > MEMO:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for i in keep], pa.binary()), pa.array([pack(t[i].as_py().encode()) for i in keep], pa.binary())], names=["digest", "z"])

    return run


def _encoder(version: str, path: str, file):
    def run(batches):
        import zstandard

        count, unpack, seen = counter(version, path, file.value), zstandard.ZstdDecompressor().decompress, set()
        for b in batches:
            d = b.column(0).to_pylist()
            z = b.column(1)
            for lo in range(0, len(d), 256):
                keep = [i for i in range(lo, min(lo + 256, len(d))) if not (d[i] in seen or seen.add(d[i]))]
                n = count([unpack(z[i].as_py()).decode() for i in keep])
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for i in keep], pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
            if len(seen) > MEMO:
                seen.clear()

    return run


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return count_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("word_bpe_49k.json"), f"{shared}/token-cache-{uuid.uuid4().hex}")
