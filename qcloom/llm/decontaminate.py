"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words become one automaton (all items in one, over word numbers). Training texts stream through it:
for each word the automaton gives the length of the longest suffix of the words read so far that occurs in some
item. Where that length reaches the window, the last `window` words are hit and the automaton's state names the
items. An item of fewer words than the window counts when it occurs whole.

A vectorised scan comes first: only runs of words whose neighbouring pairs all occur side by side in some item
can hold a match of two words or more, so that the automaton reads those runs alone; no match can cross their ends.

The automaton is built in a Spark task and broadcast. Its size is checked: item words are counted first, and more
than `automaton_words` of them are dealt by the hash of item and text to several automata, built in a task each and
kept as a table in the shared folder. Texts pass CHAIN of them, or CHAIN_BYTES, in a narrow chain (no shuffle), then the rows are
checkpointed and those broadcasts freed, so that memory doesn't grow with the benchmark. An item of more than a
quarter of `automaton_words` goes in overlapping pieces. Hits and items are the same as with one automaton; the
longest match is then the longest inside one piece.

Defined cases: a null or empty text has no words and no hits; null or empty items are ignored; the texts of
an id that repeats all count for it; a null item id reads as the empty string; repeated documents are judged row by row; an empty
table gives no rows; other columns, whatever their names, pass through clean() untouched.
"""

from __future__ import annotations

import pickle
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import spread
from .common import LETTER_DIGIT, cut, flat, fresh, small_batches, steps, words, written

WINDOW = 10
AUTOMATON_WORDS = 200_000
CHAIN = 4  # automata that are broadcast at a time, at most
CHAIN_BYTES = 320_000_000  # and what several of them may take in a worker
LOADED = 20  # an automaton's size in a worker over its pickled size, as measured: 160 MB of 8.4 MB
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text


class Automaton:
    """Generalised suffix automaton over integer symbols; each item is added from the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, symbols) -> None:
        last = 0
        for c in symbols:
            q = self.next[last].get(c)
            if q is not None:  # this prefix is known from another item
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(self.len[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
            last = new

    def read(self, symbols):
        """For each symbol: (state, length) of the longest match that ends there."""
        s = n = 0
        nxt, link, length = self.next, self.link, self.len
        for c in symbols:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            yield s, n

    def cut(self, s: int, size: int) -> int:
        """The state of the last `size` symbols of a longer match."""
        while self.len[self.link[s]] >= size:
            s = self.link[s]
        return s


class Index:
    """What is broadcast: the automaton of some items, their words and pairs of words."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        seqs = []
        for item, text in items:
            buf, offs = flat(pa.array([text], pa.large_string()))
            h = words(buf, offs, LETTER_DIGIT)[2]
            if len(h):
                seqs.append((item, h))
        self.vocab = np.unique(np.concatenate([h for _, h in seqs])) if seqs else np.empty(0, np.uint64)
        v = np.int64(len(self.vocab) + 1)
        seqs = [(i, np.searchsorted(self.vocab, h).astype(np.int64)) for i, h in seqs]
        self.pairs = np.unique(np.concatenate([x[:-1] * v + x[1:] for _, x in seqs])) if seqs else np.empty(0, np.int64)
        self.shortest = min([window, *(len(x) for _, x in seqs)])
        self.a = a = Automaton()
        for _, x in seqs:
            a.add(x.tolist())
        self.items: dict[int, set[str]] = {}  # window's state -> items
        self.short: dict[int, tuple[int, set[str]]] = {}  # state of a whole short item -> its length, items
        for item, x in seqs:
            if len(x) < window:
                *_, (s, _) = a.read(x.tolist())
                s = a.cut(s, len(x))
                self.short.setdefault(s, (len(x), set()))[1].add(item)
            else:
                for s, n in a.read(x.tolist()):
                    if n >= window:
                        self.items.setdefault(a.cut(s, window), set()).add(item)

    def runs(self, h: np.ndarray, first: np.ndarray):
        """Runs of words that may hold a match: start, end and the words' numbers."""
        if not len(self.vocab) or not len(h):
            return [], [], None
        at = np.searchsorted(self.vocab, h).clip(max=len(self.vocab) - 1)
        known = self.vocab[at] == h
        ids = at.astype(np.int64)
        joined = np.zeros(len(h), bool)  # word i goes on from word i - 1
        if len(h) > 1:
            both = known[1:] & known[:-1]
            code = ids[:-1] * np.int64(len(self.vocab) + 1) + ids[1:]
            p = np.searchsorted(self.pairs, code).clip(max=max(len(self.pairs) - 1, 0))
            joined[1:] = both & (self.pairs[p] == code if len(self.pairs) else False)
        inner = first[:-1][first[:-1] < len(h)]
        joined[inner] = False
        begin = np.flatnonzero(known & ~joined)
        stop = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = stop - begin >= self.shortest
        return begin[long], stop[long], ids

    def match(self, symbols: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit intervals over these symbols, the items that occur, the longest match."""
        a, spans, found, longest = self.a, [], set(), 0
        for i, (s, n) in enumerate(a.read(symbols)):
            longest = max(longest, n)
            if n >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                found |= self.items[a.cut(s, self.window)]
            if self.short:
                t = a.cut(s, self.window) if n >= self.window else s
                while t > 0:
                    if (x := self.short.get(t)) and x[0] <= n:
                        spans.append((i + 1 - x[0], i + 1))
                        found |= x[1]
                    t = a.link[t]
        return spans, found, longest


def merge(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class _Packed:
    """A pickled Index that workers unpack; the driver passes the bytes on and never holds the automaton."""

    def __init__(self, blob: bytes) -> None:
        self.blob = blob

    def __reduce__(self):
        return pickle.loads, (self.blob,)


def _pieces(items: DataFrame, item_col: str, text_col: str, window: int, size: int) -> DataFrame:
    """(i, t, n): the items' texts, those of more than `size` words in pieces of so many that share window - 1 words,
    so that every window lies whole in some piece and no piece is shorter than a window."""
    step = size - window + 1
    w = F.regexp_extract_all(F.translate("t", string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))
    all_ = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    cut_ = all_.withColumn("w", w).where(F.size("w") > 0).withColumn("p", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int")))))
    return cut_.select("i", F.slice("w", F.col("p") * step + 1, size).alias("w")).select("i", F.array_join("w", " ").alias("t"), F.size("w").alias("n"))


def _packed(items: DataFrame, item_col: str, text_col: str, window: int, most: int):
    """Pickled indexes, at least one. Each is built in a task of its own, from at most about `most` words; the driver
    holds the bytes of one at a time."""
    parts = _pieces(items, item_col, text_col, window, max(most // 4, 2 * window))
    total = parts.agg(F.sum("n")).first()[0] or 0
    if not total:
        yield pickle.dumps(Index([], window))
        return
    shards = -(-2 * total // most) if total > most else 1

    def build(key, pdf):
        return pd.DataFrame({"k": [key[0]], "blob": [pickle.dumps(Index(list(zip(pdf["i"], pdf["t"])), window), protocol=5)]})

    built = parts.select(F.pmod(F.xxhash64("i", "t"), F.lit(shards)).cast("long").alias("k"), "i", "t").groupBy("k").applyInPandas(build, "k long, blob binary")
    if shards == 1:
        yield bytes(built.first().blob)
        return
    built = written(built)
    for k in sorted(r.k for r in built.select("k").collect()):
        yield bytes(built.where(F.col("k") == k).first().blob)


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, names: tuple[str, ...] = ("n_words", "n_hit", "longest", "spans", "items")) -> DataFrame:
    """docs' columns `keep` and, by the names given: number of words, words hit, longest match, hit intervals as
    int64 pairs of byte offsets (first, end) in a binary, and the sorted items found."""
    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.StringType()))):
        schema = schema.add(name, kind)
    small_batches(docs.sparkSession)
    carry = list(dict.fromkeys([*keep, text_col]))
    df = docs.select(*carry)
    done, waiting, held = False, [], 0  # waiting: broadcasts that df still reads, held: their bytes
    packed = _packed(items, item_col, item_text, window, automaton_words)
    blob = next(packed)
    while blob is not None:
        after = next(packed, None)
        if waiting and (len(waiting) == CHAIN or (held + len(blob)) * LOADED > CHAIN_BYTES):
            df = cut(df)
            for b in waiting:
                b.destroy()
            waiting, held = [], 0
        held += len(blob)
        waiting.append(docs.sparkSession.sparkContext.broadcast(_Packed(blob)))
        out_cols = keep if after is None else carry
        out = T.StructType([docs.schema[c] for c in out_cols] + schema.fields[len(keep) :])
        df = df.mapInArrow(_scanner(waiting[-1], text_col, out_cols, names, done), out)
        done, blob = True, after
    return df


def _scanner(shared, text_col: str, out_cols: list[str], names: tuple[str, ...], again: bool):
    def run(batches):
        index: Index = shared.value
        for batch in batches:
            n_words, n_hit, longest, spans, items = [], [], [], [], []
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            old = [col(c).to_pylist() for c in names[2:]] if again else None
            for i, j, buf, offs in steps(batch, text_col):
                starts, ends, h, first = words(buf, offs, LETTER_DIGIT)
                count = np.diff(first)
                found: dict[int, tuple[list, set, int]] = {}
                begin, stop, ids = index.runs(h, first)
                owner = np.searchsorted(first, begin, side="right") - 1
                for a, b, d in zip(begin, stop, owner) if len(begin) else ():
                    got, its, most = index.match(ids[a:b].tolist())
                    x = found.setdefault(int(d), ([], set(), 0))
                    shift = int(a - first[d])
                    x[0].extend((s + shift, e + shift) for s, e in got)
                    x[1].update(its)
                    found[int(d)] = (x[0], x[1], max(x[2], most))
                for d in range(j - i):
                    sp, its, most = found.get(d, ([], set(), 0))
                    w0, base = int(first[d]), int(offs[d])
                    sp = merge(sp)
                    if again:  # intervals in words of the automata before
                        was = np.frombuffer(old[1][i + d], np.int64).reshape(-1, 2) + base
                        ws = np.searchsorted(starts, was[:, 0]) - w0
                        we = np.searchsorted(ends, was[:, 1]) + 1 - w0
                        sp = merge([*sp, *zip(ws.tolist(), we.tolist())])
                        its, most = its | set(old[2][i + d]), max(most, old[0][i + d])
                    n_words.append(int(count[d]))
                    n_hit.append(sum(e - s for s, e in sp))
                    longest.append(most)
                    spans.append(np.array([(starts[w0 + s] - base, ends[w0 + e - 1] - base) for s, e in sp], np.int64).tobytes())
                    items.append(sorted(its))
            arrays = [col(c) for c in out_cols] + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(longest, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*out_cols, *names])

    return run


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", max_length: int = WINDOW, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without contamination: hit spans of documents whose longest match reaches max_length words are cut out
    of the text; documents of which more than max_coverage of the words are hit go. All columns stay; n_chars,
    where there is such a column of whole numbers, follows the text."""
    names = tuple(fresh(docs, "_words", "_hit", "_longest", "_spans", "_items"))
    got = scan(docs, items, docs.columns, text_col, window=min(max_length, options.pop("window", max_length)), names=names, **options)
    kept = got.where(F.col(names[1]) <= F.lit(float(max_coverage)) * F.col(names[0]))

    def cutter(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            text = batch.column(k)
            spans = batch.column(batch.schema.get_field_index(names[3])).to_pylist()
            if any(spans):
                out = []
                for t, s in zip(text.to_pylist(), spans):
                    if s:
                        raw = t.encode()
                        at = [0, *np.frombuffer(s, np.int64).tolist(), len(raw)]
                        t = b" ".join(raw[a:b].strip() for a, b in zip(at[::2], at[1::2])).decode().strip()
                    out.append(t)
                text = pa.array(out, text.type)
            cols = [text if i == k else batch.column(i) for i in range(len(docs_cols))]
            yield pa.RecordBatch.from_arrays(cols, names=docs_cols)

    docs_cols = list(docs.columns)
    return with_length(kept.mapInArrow(cutter, docs.schema), text_col)


def with_length(docs: DataFrame, text_col: str = "text", col: str = "n_chars") -> DataFrame:
    """n_chars, if it is there, as the text's length in characters."""
    if col in docs.columns and isinstance(docs.schema[col].dataType, (T.LongType, T.IntegerType)):
        return docs.withColumn(col, F.length(text_col).cast(docs.schema[col].dataType))
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = spread(docs)
    got = scan(docs, items, ["doc_id"])
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS k
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT d.*, s.k, unnest(range(1, len(w) - s.k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) s WHERE len(w) >= s.k)),
m AS (SELECT dw.doc_id, dw.p, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.l, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
