"""Collocation mining: phrases of words that stand together more often than chance has it, by language.

Texts are cut into pieces at punctuation and line ends, pieces into words. Which phrases occur `least` times is found
in two passes after a count of the words:

1. Misra-Gries summaries. Every task counts the runs of 1 to `run` words of about FLUSH words of text at a time; each
   run is a hash, whose upper half names one of P hash partitions. A partition's local counts are summaries that are
   merged: counters add up, and where there are more than the capacity, the largest counter beyond it is subtracted
   from all and those that are used up go. The capacity is the partition's mass (all occurrences of its runs) over
   `least`, rounded down, plus one, so that what is subtracted in all stays below `least` and every run that occurs so
   often survives. P grows with the mass, so that a summary's size doesn't.
2. Exact counts of the survivors. Each hash partition's task makes a Bloom filter of its survivors, and all filters, BITS bits a
   survivor and FILTER_BYTES at most, are broadcast: runs of other hashes are left out in the task that reads them. What
   a filter lets pass is counted exactly, so that its errors, and its being small, cost a little shuffle and nothing else.

A frequent run is one entry for each local count, however often it occurs, so that no partition is hot. Scores are exact
decimal arithmetic, and the best of a language are cut to rank by salted steps, so that a language is no hot task.

Defined cases: null texts are empty and have no words; a null language is `und`, as is a language of that name; words may
hold any other characters, line separators beyond ASCII too; repeated rows count as often as they occur; an empty
table gives no rows; other columns, whatever their names, are ignored. Runs are told apart by 64-bit hashes in one
local count, by their words from there on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import LOWER, mix64, shuffle_parts, small_batches, steps, table, words, written

LEAST = 10
RUN = 3
TOP = 2000
COVERED = 50  # per cent of a candidate's occurrences within one longer candidate
FLUSH = 500_000  # words whose runs are counted at a time
PART_MASS = 4_000_000  # occurrences in a hash partition, about: 20 MB of summaries that arrive, 5 MB that are kept
BITS = 12  # of a partition's filter for each survivor
FILTER_BYTES = 1 << 26  # of all filters together; beyond that they have fewer bits a survivor

BREAK = table(lambda c: chr(c) in ".,;:!?" or 0x0A <= c <= 0x0D)
IN_WORD = table(lambda c: c not in (0x20, 0x09) and not BREAK[c])


class Runs:
    """Words of some texts put together, each with the number of words that follow it in its piece."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.words = 0
        self.bytes = 0

    def add(self, buf: np.ndarray, offs: np.ndarray, salt: np.ndarray, lang: np.ndarray) -> None:
        """Texts with a salt and a number for the language of each."""
        starts, ends, h, first = words(buf, offs, IN_WORD)
        if not len(starts):
            return
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        breaks = np.cumsum(BREAK[buf])[starts]
        ends_here = np.ones(len(starts), bool)
        ends_here[:-1] = (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1])
        last = np.flatnonzero(ends_here)
        follow = last[np.searchsorted(last, np.arange(len(starts)))] - np.arange(len(starts))
        size = ends - starts
        inside = IN_WORD[LOWER[buf]]
        begin = np.cumsum(size + 1) - (size + 1)
        flat = np.full(int((size + 1).sum()), 0x20, np.uint8)  # the words, a space behind each
        at = np.flatnonzero(inside)
        flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(at))] = LOWER[buf[at]]
        self.parts.append((h, follow, size, begin + self.bytes, flat, salt[text], lang[text]))
        self.words += len(h)
        self.bytes += len(flat)

    def counts(self, run: int):
        """For 1, 2 ... words: (distinct hashes, the place of one run of each, its number)."""
        h, follow, self.size, self.begin, self.flat, salt, self.lang = (np.concatenate(x) for x in zip(*self.parts))
        at, now = np.arange(len(h)), mix64(h ^ salt)
        for k in range(1, run + 1):
            yield k, *np.unique(now, return_index=True, return_counts=True), at
            more = follow[at] >= k
            at, now = at[more], now[more]
            now = mix64(now * np.uint64(0x9E3779B97F4A7C15) + h[at + k])

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each place on, a space between them."""
        a = self.begin[at]
        n = self.begin[at + k - 1] + self.size[at + k - 1] - a
        offs = np.concatenate([[0], np.cumsum(n)])
        data = self.flat[np.repeat(a - offs[:-1], n) + np.arange(offs[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


def _gathered(batches, flush: int):
    """Runs of about `flush` words each, with the languages' names."""
    runs, names = Runs(), {}
    for batch in batches:
        code = batch.column(batch.schema.get_field_index("_lang")).dictionary_encode()
        these, of = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
        salt = np.array([_salt(x) for x in these], np.uint64)[of]
        for i, j, buf, offs in steps(batch, "_text"):
            number = np.array([names.setdefault(x, len(names)) for x in these], np.int64)
            runs.add(buf, offs, salt[i:j], number[of[i:j]])
            if runs.words >= flush:
                yield runs, list(names)
                runs, names = Runs(), {}
    if runs.words:
        yield runs, list(names)


def _keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition in the upper 32 bits, half of the hash in the lower."""
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) << np.int64(32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def prune(h: np.ndarray, n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of `capacity` counters at most, and what was subtracted from each."""
    if len(n) <= capacity:
        return h, n, 0
    off = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
    left = n > off
    return h[left], n[left] - off, off


def merge(summaries, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One summary of all (hashes, counters) given, and what was subtracted in all. Counters are taken in until there are
    twice as many as the capacity, then pruned."""
    h, n, off = np.empty(0, np.uint32), np.empty(0, np.int64), 0
    new, waiting = [], 0

    def put(h, n, off):
        all_h = np.concatenate([h, *(x for x, _ in new)])
        order = np.argsort(all_h, kind="stable")
        all_h, all_n = all_h[order], np.concatenate([n, *(y for _, y in new)])[order]
        at = np.flatnonzero(np.concatenate([[True], all_h[1:] != all_h[:-1]]))
        h, n, more = prune(all_h[at], np.add.reduceat(all_n, at), capacity)
        return h, n, off + more

    for x, y in summaries:
        new.append((x, y))
        waiting += len(x)
        if waiting >= capacity:
            h, n, off = put(h, n, off)
            new, waiting = [], 0
    if waiting:
        h, n, off = put(h, n, off)
    return h, n, off


def probe(h: np.ndarray, bits, k: int) -> np.ndarray:
    """The k-th place of each hash in a filter of so many bits."""
    return (mix64(h.astype(np.uint64) + np.uint64(k << 32)) % bits).astype(np.int64)


class Filters:
    """The Bloom filters of all hash partitions, end to end."""

    def __init__(self, parts: int, slices: list[tuple[int, bytes]]) -> None:
        size = np.zeros(parts, np.int64)
        for p, b in slices:
            size[p] = len(b)
        self.base = np.cumsum(size) - size
        self.bits = np.maximum(size * 8, 1).astype(np.uint64)
        self.some = size > 0
        self.data = np.frombuffer(b"".join(b for _, b in sorted(slices)) or b"\0", np.uint8)

    def holds(self, key: np.ndarray) -> np.ndarray:
        """Places of the keys that may be among the survivors."""
        p = key >> np.int64(32)
        at = np.flatnonzero(self.some[p])
        for k in range(3):
            q = p[at]
            bit = probe(key[at] & np.int64(0xFFFFFFFF), self.bits[q], k)
            at = at[(self.data[self.base[q] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return at


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of each language, of `_text` and `_lang`."""

    def count(batches):
        total: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("_lang")).to_pylist()
            for i, j, buf, offs in steps(batch, "_text"):
                first = words(buf, offs, IN_WORD, hashes=False)[3]
                for lang, n in zip(langs[i:j], np.diff(first).tolist()):
                    total[lang] = total.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "n"])

    return docs.mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def survivors(docs: DataFrame, parts: int, run: int = RUN, least: int = LEAST, flush: int = FLUSH, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(p, n, filter): for each hash partition the number of runs that may occur `least` times, and a Bloom filter of
    their hashes; none that does is missing."""

    def local(batches):
        for runs, _ in _gathered(batches, flush):
            found = [(h, n) for _, h, _, n, _ in runs.counts(run)]
            key, n = _keys(np.concatenate([h for h, _ in found]), parts), np.concatenate([n for _, n in found])
            order = np.argsort(key)
            key, n = key[order], n[order]
            times = (n + 254) // 255  # a counter is a byte; larger ones are several entries
            key, last = np.repeat(key, times), np.cumsum(times) - 1
            over = np.full(len(key), 255, np.int64)
            over[last] = n - 255 * (times - 1)
            n, p = over, key >> np.int64(32)
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            ends = np.append(at[1:], len(p))
            low, n = (key & np.int64(0xFFFFFFFF)).astype(np.uint32), n.astype(np.uint8)
            for a in range(0, len(at), 64):
                b = range(a, min(a + 64, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p[at[b]], pa.int64()), pa.array([low[at[x] : ends[x]].tobytes() for x in b], pa.binary()), pa.array([n[at[x] : ends[x]].tobytes() for x in b], pa.binary())], names=["p", "h", "n"],
                )

    def united(t: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x.as_py(), np.uint8) for x in t["n"]]
        mass = sum(int(x.sum(dtype=np.int64)) for x in counts)
        given = ((np.frombuffer(x.as_py(), np.uint32), y.astype(np.int64)) for x, y in zip(t["h"], counts))
        h, n, off = merge(given, mass // least + 1)
        h = h[n + off >= least]
        size = min(-(-len(h) * BITS // 8), max(filter_bytes // parts, 8))
        bits = np.zeros(size * 8, np.uint8)
        for k in range(3) if size else ():
            bits[probe(h, np.uint64(size * 8), k)] = 1
        return pa.table({"p": t["p"][:1], "n": pa.array([len(h)], pa.int64()), "filter": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return docs.mapInArrow(local, "p long, h binary, n binary").groupBy("p").applyInArrow(united, "p long, n long, filter binary")


def frequent(docs: DataFrame, alive: DataFrame, parts: int, run: int = RUN, least: int = LEAST, flush: int = FLUSH) -> DataFrame:
    """(lang, k, phrase, f): the exact number of occurrences of every run of k words that occurs `least` times."""
    shared = docs.sparkSession.sparkContext.broadcast(Filters(parts, [(r.p, bytes(r.filter)) for r in alive.where("n > 0").select("p", "filter").collect()]))

    def local(batches):
        filters = shared.value
        for runs, langs in _gathered(batches, flush):
            names = pa.array(langs, pa.string())
            for k, h, place, n, at in runs.counts(run):
                good = filters.holds(_keys(h, parts))
                where, n = at[place[good]], n[good].astype(np.int64)
                for a in range(0, len(where), 50_000):
                    w = where[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(runs.lang[w])), pa.array(np.full(len(w), k, np.int32)), runs.phrases(w, k).cast(pa.string()), pa.array(n[a : a + 50_000])], names=["lang", "k", "phrase", "f"],
                    )

    return docs.mapInArrow(local, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(freq: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates (two words or more) that no longer candidate covers."""
    cands = freq.where("k > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = cands.select("lang", "phrase", "a", "k", "w", cut).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    part = freq.select("lang", "phrase", "f")
    cuts = cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    # the quotient is at most 10^6 times, as l and r are at least a; the products have up to 38 digits
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    longer = cands.where("k > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rows with their rank in their language, the first `top`: in salted steps, each of which leaves `top` rows a group."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for salts in (1024, 32, 1):
        group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))) if salts > 1 else Window.partitionBy("lang")
        rows = rows.withColumn("rank", F.row_number().over(group.orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, run: int = RUN, top: int = TOP, covered: int = COVERED, part_mass: int = PART_MASS, filter_bytes: int = FILTER_BYTES, flush: int = FLUSH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `run` words. a, l and r are the occurrences of
    the phrase and of its two parts at its weakest cut, n the words of the language, score = floor(10^6 a a / (l r))."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"))
    per_lang = written(word_counts(src))
    mass = run * (per_lang.agg(F.sum("n")).first()[0] or 0)
    parts = max(shuffle_parts(spark), -(-mass // part_mass))
    alive = written(survivors(src, parts, run, least, flush, filter_bytes))
    freq = written(frequent(src, alive, parts, run, least, flush))
    return best(scored(freq, covered), top).join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w)::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (
  SELECT u.lang, u.phrase, a, cut, fl.f AS l, fr.f AS r, ((1000000::HUGEINT * a * a) // (fl.f::HUGEINT * fr.f))::BIGINT AS score
  FROM u JOIN f fl ON fl.lang = u.lang AND fl.phrase = x JOIN f fr ON fr.lang = u.lang AND fr.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
k AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND c.k = 3 AND 100 * c.a >= 50 * b.a AND array_to_string(c.w[1:2], ' ') = b.phrase)
  AND NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND c.k = 3 AND 100 * c.a >= 50 * b.a AND array_to_string(c.w[2:3], ' ') = b.phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT k.*, n.n, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k JOIN n USING (lang)) WHERE rank <= 2000
"""
