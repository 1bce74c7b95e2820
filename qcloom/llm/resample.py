"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its runs of 1 to 3 words, each hashed into one of `buckets` by CRC-32. One pass counts the
buckets of all documents, one those of the target texts; a bucket's gain is its rounded log ratio, and the gains,
`buckets` numbers whatever the input, are the array that scores every document in a third pass: its weight is the sum
of its features' gains. Adding a fixed draw of Gumbel noise to each weight and taking the highest scores draws
documents without replacement, with odds in proportion to exp(weight).

The scored rows are written once (no texts in them). The cut-off is found by bisection: exact count jobs over the
written scores, each with PROBES thresholds at once, close in on the score of the last document drawn; where it is
tied, on the smallest ids among the ties; where an id is tied as well, on the written rows' own numbers. So nothing is
sorted but what is drawn: those rows are range-partitioned by score and id, written, and numbered by the sizes of the
partitions before them.

CRC-32 is linear, so that the CRC of a run is that of its beginning, shifted by table for as many bytes as the next
word and its space have, xor that of the next word: no run's bytes are put together.

Defined cases: null texts, and texts without words, have no features and weight 0; a null id draws as an empty one,
and comes last among ties; rows that repeat an id and a score are told apart by the written rows' numbers, so that
exactly as many are drawn as should be; an empty table gives no rows; with empty targets all gains come from the
documents alone; other columns, whatever their names, are ignored, or carried by resample().
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import spread
from .common import LETTER_DIGIT, LOWER, fresh, shuffle_parts, small_batches, steps, words, written

BUCKETS = 10_000
RUN = 3  # words of the longest feature
LEAST_WORDS = 20
PERCENT = 5
PROBES = 15  # thresholds counted in one job: four halvings
SHORT = 64  # bytes; longer words are hashed singly

# --------------------------------------------------------------------------- CRC-32 of runs of words


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_BYTE_CRC = _byte_table()


def _zero(c: np.ndarray) -> np.ndarray:
    """c with one zero byte behind it, but for the inversions."""
    return _BYTE_CRC[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map, given by what it makes of each value of each of four bytes."""
    out = tables[0][c & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(c >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps for 0 to SHORT + 1 zero bytes in one table, and for 1, 2, 4, 8 ... of them."""
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    few = [now]
    for _ in range(SHORT + 1):
        few.append(_zero(few[-1]))
    powers = [few[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(few), powers


_FEW, _POWERS = _shifts()


def shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs c as if n more bytes came behind, to be xored with the CRC of those bytes."""
    m = np.minimum(n, SHORT + 1)
    out = _FEW[m, 0, c & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ _FEW[m, k, (c >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(n > SHORT + 1):
        one, left, bit = c[i : i + 1], int(n[i]), 0
        while left:
            if left & 1:
                one = _apply(_POWERS[bit], one)
            left, bit = left >> 1, bit + 1
        out[i] = one[0]
    return out


def word_crcs(low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: byte by byte, all words at once."""
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    at, n = starts[order], size[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-n, -np.arange(min(int(n.max(initial=0)), SHORT)), side="left")
    for j, k in enumerate(live.tolist()):
        c[:k] = _BYTE_CRC[(c[:k] ^ low[at[:k] + j]) & np.uint32(255)] ^ (c[:k] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = ~c
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(low[starts[i] : starts[i] + size[i]].tobytes())
    return out


def features(buf: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, run: int = RUN):
    """(first word of each text, [for 1, 2 ... words: number of the run's first word, its bucket])."""
    starts, ends, _, first = words(buf, offs, LETTER_DIGIT, hashes=False)
    if not len(starts):
        return first, []
    size = ends - starts
    one = word_crcs(LOWER[buf], starts, size)
    spaced = shift(np.full(len(one), zlib.crc32(b" "), np.uint32), size) ^ one
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(one))  # words from here to the text's end
    at, c, out = np.arange(len(one)), one, []
    for k in range(1, run + 1):
        out.append((at, (c % np.uint32(buckets)).astype(np.int64)))
        more = left[at] > k
        at, c = at[more], c[more]
        c = shift(c, size[at + k] + 1) ^ spaced[at + k]
    return first, out


# --------------------------------------------------------------------------- passes


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n) of all features of all texts. A task sends each bucket once."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offs in steps(batch, text_col):
                for _, b in features(buf, offs, buckets, run)[1]:
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    return texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> list[int]:
    """The gain of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). Only `buckets` numbers come to the driver."""
    spark = docs.sparkSession
    s = bucket_counts(docs, text_col, buckets, run).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_text, buckets, run).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    rows = both.select("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t")).toPandas().sort_values("bucket")
    s_, t_ = rows["s"].to_numpy(), rows["t"].to_numpy()
    ratio = (t_ + 1.0) * (s_.sum() + float(buckets)) / ((s_ + 1.0) * (t_.sum() + float(buckets)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64).tolist()


def weigh(docs: DataFrame, gain: list[int], keep: list[str], text_col: str = "text", run: int = RUN, names: tuple[str, ...] = ("n_words", "n_features", "weight")) -> DataFrame:
    """docs' columns `keep` and, by the names given: number of words, of features, sum of the features' gains."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(np.array(gain, np.int64))
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in names])

    def score(batches):
        g = shared.value
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for _, _, buf, offs in steps(batch, text_col):
                first, runs = features(buf, offs, len(g), run)
                n = np.diff(first)
                sums, many = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for k, (at, b) in enumerate(runs):
                    bounds = np.searchsorted(at, first)
                    upto = np.concatenate([[0], np.cumsum(g[b])])
                    sums += upto[bounds[1:]] - upto[bounds[:-1]]
                    many += np.maximum(n - k, 0)
                n_words.append(n)
                n_features.append(many)
                weight.append(sums)
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            new = [pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*keep, *names])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(score, out)


def noise(id_col: str, seed: int = 42):
    """Standard Gumbel noise in thousandths, rounded down, fixed by seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# --------------------------------------------------------------------------- the draw


def _counts(rows: DataFrame, col: str, at: list[int]) -> list[int]:
    got = rows.agg(*[F.count_if(F.col(col) <= x).alias(f"c{i}") for i, x in enumerate(at)]).first()
    return [got[i] for i in range(len(at))]


def cutoff(rows: DataFrame, col: str, need: int) -> tuple[int, int]:
    """The smallest value v of an integer column with at least `need` rows <= v, and the number of rows < v. Each job
    counts at PROBES values between those known to be too small and large enough; null values count as above all."""
    low, high = rows.agg(F.min(col), F.max(col)).first()
    low, below = low - 1, 0  # fewer than need rows are <= low, enough are <= high
    while high - low > 1:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        at = list(range(low + step, high, step))
        n = _counts(rows, col, at)
        for v, k in zip(at, n):
            if k >= need:
                high = v
                break
            low, below = v, k
    return high, below


def ranked(scored: DataFrame, need: int, id_col: str, score: str = "score", row: str = "row", rank: str = "rank") -> DataFrame:
    """scored, a written table whose `row` tells rows apart, with the rank of the `need` rows of highest score (ties to the
    smaller id, null ids last, then the smaller row); the others have none. It has `need` rows with a score or more."""
    key, low = fresh(scored, "_key", "_pid")
    live = F.col(score).isNotNull()
    if not need:
        return scored.withColumn(rank, F.lit(None).cast("long"))
    picked, tied, left, steps_ = F.lit(False), live, need, []
    for value in (-F.col(score), F.col(id_col).cast("long"), F.col(row)):
        rows = scored.where(tied).select(value.alias(key))
        nulls = value.isNull()
        some = rows.where(F.col(key).isNotNull()).count()
        if some < left:  # only ids can be null: all others come first
            steps_.append(tied & ~nulls)
            left -= some
            tied = tied & nulls
            continue
        v, below = cutoff(rows, key, left)
        steps_.append(tied & (value < v))
        tied, left = tied & (value == v), left - below
        if rows.where(F.col(key) == v).count() == left:
            steps_.append(tied)
            break
    for s in steps_:
        picked = picked | F.coalesce(s, F.lit(False))
    order = [F.col(score).desc(), F.col(id_col).asc_nulls_last(), F.col(row).asc()]
    parts = shuffle_parts(scored.sparkSession)
    drawn = written(scored.where(picked).repartitionByRange(parts, *order).withColumn(low, F.spark_partition_id()))
    sizes = {r[low]: r["n"] for r in drawn.groupBy(low).agg(F.count("*").alias("n")).collect()}  # one row for each of `parts`
    before, total = [], 0
    for p in range(parts):
        before.append(total)
        total += sizes.get(p, 0)
    number = F.row_number().over(Window.partitionBy(low).orderBy(*order)) + F.element_at(F.array(*[F.lit(x) for x in before]), F.col(low) + 1)
    rest = scored.where(~picked).withColumn(rank, F.lit(None).cast("long"))
    return rest.unionByName(drawn.withColumn(rank, number.cast("long")).drop(low))


def draw(docs: DataFrame, target: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS, run: int = RUN,
         names: tuple[str, ...] = ("n_features", "weight", "score", "rank")) -> DataFrame:
    """docs' columns `keep` and, by the names given: number of features, weight, score, rank in the draw or null."""
    n_features, weight, score, rank = names
    named = docs.select(*keep, F.lit(0).alias(n_features), F.lit(0).alias(weight), F.lit(0).alias(score), F.lit(0).alias(rank))
    n_words, own, mark, row = fresh(named, "_words", "_id", "_score", "_row")
    text = fresh(named, "_text")[0]
    src = docs.select(*keep, F.col(id_col).alias(own), F.col(text_col).alias(text))
    w = weigh(src, gains(docs, target, text_col, target_text, buckets, run), [*keep, own], text, run, (n_words, n_features, weight))
    w = w.withColumn(score, F.col(weight) + noise(own, seed)).withColumn(mark, F.when(F.col(n_words) >= least_words, F.col(score)))
    w = written(w.withColumn(row, F.monotonically_increasing_id()))
    need = w.where(F.col(mark).isNotNull()).count() * percent // 100
    return ranked(w, need, own, mark, row, rank).select(*keep, *names)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs' own rows that are drawn, with all their columns, and n_features, weight, score, rank (with underscores behind where
    docs has such a name). All columns are written once on the way."""
    names = tuple(fresh(docs, "n_features", "weight", "score", "rank"))
    return draw(docs, target, docs.columns, id_col, text_col, names=names, **how).where(F.col(names[3]).isNotNull())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return draw(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


#: CRC-32 in SQL: a table of 256 numbers, and a fold over the bytes of every distinct feature.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
w AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (
  SELECT side, r, unnest(w) AS f FROM w
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
n AS (SELECT side, r, f, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
c AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x)::BIGINT, 2), lambda i: ('0x' || x[i : i + 1])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
b AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM n JOIN c USING (f) GROUP BY bucket),
z AS (SELECT i AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range(10000) q(i) LEFT JOIN b ON bucket = i),
k AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM z) + 10000) / ((s + 1) * ((SELECT sum(t) FROM z) + 10000))))::BIGINT AS gain FROM z),
d AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN c USING (f) JOIN k USING (bucket) WHERE side = 'd' GROUP BY r),
e AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (r) WHERE side = 'd'),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER (PARTITION BY words >= 20) AS many FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * many // 100 THEN place END AS rank FROM o
"""
