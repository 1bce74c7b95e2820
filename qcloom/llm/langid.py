"""Language identification with error-correcting output codes over byte n-grams.

Each learned language has a codeword of bits. For every bit a binary classifier tells the languages that have the
bit set from those that haven't: a log ratio of smoothed n-gram shares, each language weighing the same, over hashed
byte trigrams. Its mean over a text's trigrams is the bit's margin. Decoding is loss-weighted: a codeword's
distance is the sum over bits of the bit's weight (how well it split the training texts' n-gram counts) times
the logistic loss of its margin, and the nearest codeword wins. Its score is the softmax of minus the distances;
a runner-up close behind flags the text as ambiguous.

Learning is one pass of counts over all labelled rows, summed by language and bucket with map-side combining, and then in
Spark to a sum for each bucket and bit; no row is sampled and no language left out. The driver gets a row for each
language (its total) and one for each bucket (bits of sums), whatever the corpus. Shares are summed as whole numbers of
2^-40, so that reruns agree. Predicting is one narrow pass.

Defined cases: a null text or one without a letter is `und` with score 0; other texts always get a learned language,
if any was learned, else `und`; very long texts are read whole; repeated rows are predicted alike; rows with a
null language or null text teach nothing; ties go to the language first in code-point order; an empty table gives no
rows; other columns, whatever their names, pass through keep_known() untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import spread
from .common import cut, fresh, small_batches, steps

BUCKETS = 1 << 13
GRAIN = float(1 << 40)  # shares are summed in these parts of 1
CHOOSE = 1000  # languages up to which the best of several random codes is taken
AMBIGUOUS = 0.6
SCALE = 12.0
UNKNOWN = "und"


def _lower(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters lower-cased; ASCII that is no letter becomes a space."""
    low = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)[buf]
    if len(low) > 1:
        big = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][big] += 0x20
    return low


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text, and the text of each; those with two spaces in a row, or across texts, go."""
    b = _lower(buf).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = (b[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF) + b[1:-1] * np.uint32(65599) + b[2:]) * np.uint32(2654435761)
    code = (h >> np.uint32(32 - 13)).astype(np.int64)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    space = b == 32
    ok = (owner[:-2] == owner[2:]) & ~(space[:-2] & space[1:-1]) & ~(space[1:-1] & space[2:])
    return code[ok], owner[:-2][ok]


def learn_counts(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all rows."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(batch.schema.get_field_index(lang_col)).to_pylist(), dtype=object)
            for i, j, buf, offs in steps(batch, text_col):
                code, owner = grams(buf, offs)
                kinds, at = np.unique(langs[i:j].astype(str), return_inverse=True)
                m = np.bincount(at[owner] * BUCKETS + code, minlength=len(kinds) * BUCKETS).reshape(len(kinds), BUCKETS)
                for k, c in zip(kinds, m):
                    sums[k] = sums[k] + c if k in sums else c
        for k, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    r = rows.select(F.col(text_col).alias(text_col), F.col(lang_col).cast("string").alias(lang_col)).dropna()
    return r.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1: every split in two for few languages, else the best of some random codes."""
    if k <= 6:
        cols = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 1 << (k - 1))] or [[1] * k]
        return np.array(cols, np.float32).T
    size = int(np.ceil(10 * np.log2(k)))
    rng, best, gap = np.random.default_rng(7), None, -1
    if k > CHOOSE:  # random codes of this length are far apart; none occurs twice
        while best is None or len(np.unique(best, axis=0)) < k:
            best = rng.choice(np.array([-1, 1], np.float32), (k, size))
        return best
    for _ in range(40):
        m = rng.choice(np.array([-1, 1], np.float32), (k, size))
        m[:, np.abs(m.sum(0)) == k] *= np.where(np.arange(k) % 2, 1, -1)[:, None]
        d = (size - m @ m.T) / 2 + size * np.eye(k)
        if d.min() > gap:
            best, gap = m, d.min()
    return best


class Model:
    """Languages in code-point order, their codewords, and for each bit its n-gram weights and its own weight."""

    def __init__(self, langs: list[str], totals: list[int], one: np.ndarray, every: np.ndarray, code: np.ndarray) -> None:
        """one: for each bit, by bucket, the sum of n / (total + BUCKETS / 2) over the languages that have it set; every: over all."""
        self.langs, self.code = langs, code
        if not langs:
            return
        rest = 0.5 / (np.array(totals, np.float64) + 0.5 * BUCKETS)  # a language's share of an n-gram that it hasn't
        w, weigh = [], []
        for bit, mine in zip(code.T, one):
            sides = ((mine, bit > 0), (every - mine, bit < 0))
            a, b = ((x + rest[k].sum()) / k.sum() if k.any() else np.full(BUCKETS, 1.0 / BUCKETS) for x, k in sides)
            r = np.log(a) - np.log(b)
            w.append(r)
            weigh.append(max(1e-6, float(((a - b) * r).sum())))  # how far apart its two sides are
        self.w = np.stack(w, 1).astype(np.float32)
        self.weight = np.array(weigh) / np.sum(weigh)

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its score, the runner-up's score."""
        n = len(offs) - 1
        code, owner = grams(buf, offs)
        m = np.zeros((n, BUCKETS), np.float32)
        m += np.bincount(owner * BUCKETS + code, minlength=n * BUCKETS).reshape(n, BUCKETS)
        margin = (m @ self.w) / np.maximum(m.sum(1, keepdims=True), 1) * SCALE
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.weight
        p = np.exp(-SCALE * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(n), best]
        p[np.arange(n), best] = 0
        return best, top, p.max(1)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    spark = rows.sparkSession
    small_batches(spark)
    counts = cut(learn_counts(rows, text_col, lang_col))
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a row for each language
    langs = sorted(totals)
    code = codewords(len(langs)) if langs else np.empty((0, 0), np.float32)
    bits = code.shape[1]
    known = spark.createDataFrame([(x, totals[x] + 0.5 * BUCKETS, (c > 0).tolist()) for x, c in zip(langs, code)], "lang string, over double, bits array<boolean>")
    share = counts.join(known, "lang").select("bucket", "bits", F.round(F.col("n") * GRAIN / F.col("over")).cast("long").alias("s"))
    sums = share.groupBy("bucket").agg(F.sum("s").alias("every"), *[F.sum(F.when(F.get("bits", F.lit(k)), F.col("s"))).alias(f"b{k}") for k in range(bits)])
    one, every = np.zeros((bits, BUCKETS)), np.zeros(BUCKETS)
    for r in sums.collect():  # BUCKETS rows of bits sums at most
        every[r[0]] = r[1] / GRAIN
        one[:, r[0]] = [(x or 0) / GRAIN for x in r[2:]]
    return Model(langs, [totals[x] for x in langs], one, every, code)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names=("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs' columns `keep` with lang_pred, score and ambiguous."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = fresh(docs, "_letter")[0]
    carry = list(dict.fromkeys([*keep, text_col]))
    df = docs.select(*carry, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letter))

    def run(batches):
        m: Model = shared.value
        names_of = np.array([*m.langs, UNKNOWN], dtype=object)
        for batch in batches:
            n = batch.num_rows
            best, score, unsure = np.full(n, len(m.langs)), np.zeros(n), np.zeros(n, bool)
            has = np.array(batch.column(batch.schema.get_field_index(letter)).to_pylist(), bool)
            if m.langs:
                for i, j, buf, offs in steps(batch, text_col):
                    for lo in range(i, j, 512):
                        hi = min(lo + 512, j)
                        o = offs[lo - i : hi - i + 1]
                        best[lo:hi], score[lo:hi], second = m.predict(buf[o[0] : o[-1]], o - o[0])
                        unsure[lo:hi] = score[lo:hi] < AMBIGUOUS
            best[~has], score[~has], unsure[~has] = len(m.langs), 0.0, False
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names_of[best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(unsure, pa.bool_())], names=[*keep, *names])

    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())):
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without those that are rejected: no letter at all, or no language stands out from the others."""
    names = fresh(docs, "_lang", "_score", "_unsure")
    got = predict(docs, model, docs.columns, text_col, names)
    return got.where((F.col(names[0]) != UNKNOWN) & ~F.col(names[2])).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit(docs.where(~held_out()))
    return predict(docs, model, ["doc_id"]).withColumn("held_out", held_out())
