"""N-gram Jaccard join by prefix filters under several global orders.

A document is its set of distinct five-word shingles. Two sets that reach the similarity share so many shingles that,
under ANY one order of all shingles, the first few of both (their prefixes) must have some in common. Each order is
a filter of its own, and a pair must pass them all before it is verified:

1. Order of hashes, longer prefixes: a document's prefix must hold several shingles that other texts' prefixes hold
   too. This needs no statistics, runs over all documents, and most of them end here.
2. Rare first among those that are left (a shingle that only one has goes first; then by frequency): shared
   prefix shingles connect documents into groups.
3. Inside a group, candidates must also share prefix shingles under "rare first, then smallest hash" and "rare first,
   then largest hash"; what passes all is verified on the whole sets.

Identical sets are one class from the start. A group isn't expanded into pairs: links only matter across parts that
aren't connected yet, so that each member outside the group's largest part is compared with its candidates in other
parts, which is all that can change the components. For a candidate it isn't enough to share a prefix shingle: behind the
first one that both have, both must have as many left as sets of these two sizes need. Most members of a large group are
copies of one text with so many changes that they link with nothing, and they end there. A group of more than GROUP_ROWS
classes, or of more than GROUP_SHINGLES shared shingles, is never brought into one task: its members are dealt into parts
by hash, each two parts meet in a task, and any two members meet in one of them at least; the components are the same. A
part is bounded in members and in shingles, about.

Shingle hashes have 64 bits. They travel as packed arrays, one row per task and bucket, instead of a row each. In the
first filter, shingles that a task sees in several sets are known to be shared: they are counted for their sets there, and
one mark goes to the shingle's bucket, so that a shingle of a third of all documents is no hot bucket. Sets that occur in
several tasks may be counted too high by that, which only lets more of them through to the next filter. The same pass over
the texts gives every document's size and digest, which go along with the packed arrays.

Defined cases: a null text, or one without words, has an empty set and links with nothing; fewer than five words are one
shingle; very long texts are read whole; a null doc_id keeps its n_shingles and has no component; rows that repeat a
doc_id are nodes of that id; ties in any order are broken by hash; an empty table gives no rows; other columns,
whatever their names, pass through keep_one() untouched.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import NOT_SPACE, components, cut, fresh, mix64, shuffle_parts, steps, words
from .vectors import Forest

NGRAM, PERCENT = 5, 75
GROUP_ROWS = 20_000
GROUP_SHINGLES = 8_000_000  # at 12 bytes each
FEW_MEMBERS = 20  # groups of so many classes at most share calls
FLUSH, FLUSH_DOCS = 500_000, 100_000  # shingles, and documents, that a task holds before it passes them on
QUERIES, QUERY_SHINGLES = GROUP_ROWS // 2, GROUP_SHINGLES // 2  # members of a large group, and their shingles, that are one part
CHUNK = 256  # candidates that are compared at a time


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, h, first = words(buf, offs, NOT_SPACE)
    n = len(h)
    s = np.empty(0, np.uint64)
    if n >= size:
        s = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            s = mix64(s + h[k : n - size + 1 + k] + np.uint64(k + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = mix64(x + h[k : k + 1] + np.uint64(1000 + b - a))
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least(n: int, percent: int) -> int:
    """The fewest shingles that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def few(n: int) -> int:
    return max(1, n // 10)


def _each(batch, col: str = "text"):
    for i, _, buf, offs in steps(batch, col):
        for k, x in enumerate(shingle_sets(buf, offs)):
            yield i + k, x


def _packed(names: list[str], arrays: list[np.ndarray], deal: np.ndarray, buckets: int):
    """One row per bucket that has entries: bucket, and each array's part as bytes."""
    order = np.argsort(deal, kind="stable")
    edge = np.flatnonzero(np.diff(deal[order], prepend=-1, append=buckets))
    have = deal[order][edge[:-1]] if len(order) else np.empty(0, np.int64)
    parts = [[a[order[i:j]].tobytes() for i, j in zip(edge[:-1], edge[1:])] if len(order) else [] for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=["bucket", *names])


def _of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(x ^ np.uint64(0x5BD1E995)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _first_prefixes(batches, buckets: int, percent: int):
    """Prefixes in the order of hashes, packed by shingle: the shingles' low 32 bits, and for each set in turn how many
    of them are its own, its short digest and its size (0: a mark that several sets have them). Shingles of a bucket that
    agree in 32 bits by chance only let a few more sets through. Counts of shingles shared inside the task go on by set, in
    buckets from `buckets` on. What is to be known of every document goes along, a row of many documents, in buckets
    from 2 * `buckets` on: ids as cnt, 16-byte digests of the sets as key, sizes as n (~size: the id is null)."""
    held, docs, total = [], [], 0

    def flush():
        ids, keys, sizes = zip(*docs)
        whole = [np.array(ids, np.int64).tobytes(), b"".join(keys), np.array(sizes, np.int64).tobytes(), b""]
        to = 2 * buckets + xxhash.xxh3_64_intdigest(whole[0] + whole[1]) % buckets
        yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), *(pa.array([x], pa.binary()) for x in whole)], names=["bucket", "cnt", "key", "n", "tok"])
        if not held:
            return
        size = [len(t) for t, _, _ in held]
        tok, key, n = np.concatenate([t for t, _, _ in held]), np.repeat(np.array([k for _, k, _ in held], np.uint64), size), np.repeat(np.array([m for _, _, m in held], np.int32), size)
        order = np.lexsort((key, tok))
        tok, key, n = tok[order], key[order], n[order]
        new_t = np.append(True, tok[1:] != tok[:-1])
        new = new_t | np.append(True, key[1:] != key[:-1])
        tok, key, n, new_t = tok[new], key[new], n[new], new_t[new]
        at = np.cumsum(new_t) - 1
        many = np.bincount(at)[at] > 1
        sets, first, cnt = np.unique(key[many], return_index=True, return_counts=True)
        if len(sets):
            known = _packed(["cnt", "key", "n"], [cnt.astype(np.uint32), sets, n[many][first]], buckets + _of(sets, buckets), 2 * buckets)
            yield pa.RecordBatch.from_arrays([*known.columns, pa.array([b""] * known.num_rows, pa.binary())], names=[*known.schema.names, "tok"])
        n = np.where(many, 0, n).astype(np.int32)
        keep = ~many | new_t
        tok, key, n = tok[keep], key[keep], n[keep]
        deal = _of(tok, buckets)
        order = np.lexsort((n, key, deal))
        tok, key, n, deal = tok[order], key[order], n[order], deal[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (deal[1:] != deal[:-1]) | (n[1:] != n[:-1])))
        runs = _packed(["cnt", "key", "n"], [np.diff(new, append=len(tok)).astype(np.uint32), key[new], n[new]], deal[new], buckets)
        toks = _packed(["tok"], [tok.astype(np.uint32)], deal, buckets)
        yield pa.RecordBatch.from_arrays([*runs.columns, toks.column(1)], names=[*runs.schema.names, "tok"])

    for b in batches:
        ids = b.column(0).to_pylist()
        for i, x in _each(b):
            n, key = len(x), xxhash.xxh3_128_digest(x.tobytes())
            docs.append((ids[i] or 0, key, ~n if ids[i] is None else n))
            if n and ids[i] is not None:
                k = n - least(n, percent) + few(n)
                held.append((x[:k], int.from_bytes(key[:8], "big"), n))
                total += min(k, n)
            if total >= FLUSH or len(docs) >= FLUSH_DOCS:
                yield from flush()
                held, docs, total = [], [], 0
    if docs:
        yield from flush()


def _read(pdf: pd.DataFrame, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[c]), k) for c, k in kinds.items()]


def _pairs(tok: np.ndarray, key: np.ndarray, *more: np.ndarray):
    """Distinct (tok, key) entries of shingles that at least two keys have; also each one's number of keys."""
    order = np.lexsort((key, tok))
    tok, key = tok[order], key[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
    tok, key, more = tok[new], key[new], [m[order][new] for m in more]
    edge = np.flatnonzero(np.append(tok[1:] != tok[:-1], True)) if len(tok) else np.empty(0, int)
    runs = np.diff(edge, prepend=-1)
    freq = np.repeat(runs, runs)
    ok = freq > 1
    return tok[ok], key[ok], freq[ok].astype(np.int32), *(m[ok] for m in more)


def _repeated(buckets: int):
    """For each set with shingles that others have: how many, packed by set; known 1: counted inside a task before; 2: documents, as they came."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf.bucket.iloc[0]) >= 2 * buckets:
            return pdf[["bucket", "key", "cnt", "n"]].assign(known=2)
        cnt, key, n = _read(pdf, cnt=np.uint32, key=np.uint64, n=np.int32)
        known = int(pdf.bucket.iloc[0]) >= buckets
        if not known:
            (tok,) = _read(pdf, tok=np.uint32)
            key, n = np.repeat(key, cnt), np.repeat(n, cnt)
            order = np.lexsort((key, n > 0, tok))  # marks first
            tok, key, n = tok[order], key[order], n[order]
            new_t = np.append(True, tok[1:] != tok[:-1]) if len(tok) else np.empty(0, bool)
            new = new_t | np.append(True, key[1:] != key[:-1]) | np.append(True, (n[1:] > 0) != (n[:-1] > 0)) if len(tok) else new_t
            tok, key, n, new_t = tok[new], key[new], n[new], new_t[new]
            at = np.cumsum(new_t) - 1
            shared = (n > 0) & (np.bincount(at)[at] > 1) if len(tok) else new_t  # with a mark or another set
            key, first, cnt = np.unique(key[shared], return_index=True, return_counts=True)
            n = n[shared][first]
        return _packed(["key", "cnt", "n"], [key, cnt.astype(np.int32), n], _of(key, buckets), buckets).to_pandas().assign(known=int(known))

    return run


def _survivors(percent: int):
    """A row for each set that is left, its short digest; a row for each document: doc_id, n, 16-byte digest of the set (null if empty)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf.known.iloc[0]) == 2:
            ids, n = _read(pdf, cnt=np.int64, n=np.int64)
            keys, lost = b"".join(pdf.key), n < 0
            n = np.where(lost, ~n, n)
            return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), lost), "n": n, "key": [keys[16 * k : 16 * k + 16] if m else None for k, m in enumerate(n.tolist())], "short": pd.array([None] * len(n), "Int64")})
        parts = [(*_read(pdf[pdf.known == k], key=np.uint64, cnt=np.int32, n=np.int32), k) for k in (0, 1)]
        key, at, back = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
        n = np.concatenate([x[2] for x in parts])[at]
        m = len(parts[0][0])
        total, known = np.bincount(back[:m], parts[0][1], len(key)), np.zeros(len(key))
        np.maximum.at(known, back[m:], parts[1][1])  # each task that has the set says how many of all
        need = np.array([few(least(int(x), percent)) for x in n])
        short = key[total + known >= need].astype(np.int64)
        return pd.DataFrame({"doc_id": pd.array([None] * len(short), "Int64"), "n": pd.array([None] * len(short), "Int64"), "key": None, "short": short})

    return run


def _all_shingles(batches, buckets: int):
    """All shingles of the classes that are left, packed by shingle: shingle, class's id, its size."""
    held, total = [], 0

    def flush():
        tok = np.concatenate([t for t, _ in held])
        rep = np.repeat(np.array([r for _, r in held], np.int64), [len(t) for t, _ in held])
        n = np.repeat(np.array([len(t) for t, _ in held], np.int32), [len(t) for t, _ in held])
        return _packed(["tok", "rep", "n"], [tok, rep, n], _of(tok, buckets), buckets)

    for b in batches:
        reps, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k, x in _each(b):
            if xxhash.xxh3_128_digest(x.tobytes()) == keys[k]:  # not another text under the same id
                held.append((x, reps[k]))
                total += len(x)
            if total >= FLUSH:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


def _frequencies(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tok, rep, n = _read(pdf, tok=np.uint64, rep=np.int64, n=np.int32)
        tok, rep, freq, n = _pairs(tok, rep, n)
        return _packed(["tok", "rep", "freq", "n"], [tok, rep, freq, n], _of(rep.view(np.uint64), buckets), buckets).to_pandas()

    return run


def _assemble(percent: int):
    """A row per class that may still link: its size, its shared shingles and their frequencies, sorted by hash."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tok, rep, freq, n = _read(pdf, tok=np.uint64, rep=np.int64, freq=np.int32, n=np.int32)
        order = np.lexsort((tok, rep))
        tok, rep, freq, n = tok[order], rep[order], freq[order], n[order]
        edge = np.flatnonzero(np.diff(rep, prepend=rep[0] - 1)).tolist() if len(rep) else []
        rows = []
        for i, j in zip(edge, [*edge[1:], len(rep)]):
            if j - i >= least(int(n[i]), percent):
                a = prefix(tok[i:j], freq[i:j], int(n[i]), percent)
                rows.append((int(rep[i]), int(n[i]), tok[i:j].tobytes(), freq[i:j].tobytes(), a.view(np.int64).tolist()))
        return pd.DataFrame(rows, columns=["rep", "n", "tok", "freq", "first"])

    return run


def prefix(tok: np.ndarray, freq: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The shared part of the rare-first prefix: shingles that no other set has stand before it."""
    return tok[np.lexsort((tok, freq))[: len(tok) - least(n, percent) + 1]]


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers a[0] .. b[0] - 1, a[1] .. b[1] - 1 and so on, end to end."""
    size = b - a
    return np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)


class Group:
    """Sets of one group, and candidates under the three rare-first orders.

    A prefix of shingles has the places for partners of any size; for a given partner fewer count: where a shingle is the
    first that two sets share, neither has more to share than what stands behind it."""

    def __init__(self, n, tok: list[np.ndarray], freq: list[np.ndarray], percent: int) -> None:
        self.n, self.percent = np.asarray(n, np.int64), percent
        size = np.array([len(t) for t in tok])
        self.at = np.concatenate([[0], np.cumsum(size)])
        vocab, ids = np.unique(np.concatenate(tok), return_inverse=True)
        self.ids = ids.reshape(-1).astype(np.int32)
        self.mark = np.zeros(len(vocab), np.int8)
        self.wide = int(self.n.max()) + 1  # over all sizes, so that shingle and size are one sorted number
        keep = [len(t) - least(int(m), percent) + 1 for t, m in zip(tok, self.n)]
        self.orders = []
        for make in (lambda t, f: np.lexsort((t, f)), lambda t, f: np.arange(len(t)), lambda t, f: np.arange(len(t))[::-1]):
            pre = [self.ids[a + make(t, f)[:k]] for a, t, f, k in zip(self.at[:-1], tok, freq, keep)]
            long = np.array([len(x) for x in pre])
            owner = np.repeat(np.arange(len(tok)), long)
            rest = np.repeat(size, long) - _ranges(np.zeros(len(tok), np.int64), long)  # from this shingle on; those that no other set has stand before all
            key = np.concatenate(pre).astype(np.int64) * self.wide + self.n[owner]
            order = np.argsort(key, kind="stable")
            self.orders.append((pre, key[order], owner[order], rest[order]))

    def candidates(self, p: int, open_: np.ndarray) -> np.ndarray:
        """Members among open_ (a mask) that may link with member p."""
        n, size, q = int(self.n[p]), int(self.at[p + 1] - self.at[p]), self.percent
        lo, ok = least(n, q), open_
        for pre, key, owner, rest in self.orders:
            first = pre[p].astype(np.int64) * self.wide
            most = np.minimum((100 + q) * (size - np.arange(len(first))) // q - n, 100 * n // q)  # a partner's size, given what is left here
            a = np.searchsorted(key, first + lo)
            b = np.maximum(a, np.searchsorted(key, first + np.clip(most, -1, self.wide - 1), "right"))
            at = _ranges(a, b)
            who = owner[at]
            who = who[ok[who] & ((100 + q) * rest[at] >= q * (n + self.n[who]))]
            if not len(who):
                return who
            ok = np.zeros(len(self.n), bool)
            ok[who] = True
        return np.flatnonzero(ok)

    def links(self, p: int, cand: np.ndarray) -> np.ndarray:
        """Those among cand that link with member p."""
        own, a, b = self.ids[self.at[p] : self.at[p + 1]], self.at[cand], self.at[cand + 1]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.ids[_ranges(a, b)]], np.cumsum(b - a) - (b - a), dtype=np.int64)
        self.mark[own] = 0
        return cand[100 * both >= self.percent * (self.n[p] + self.n[cand] - both)]


def connect(g: Group) -> list[tuple[int, int]]:
    """Edges that connect all members which links connect. A member that was asked needs no more answers, and one
    that is connected already isn't compared again."""
    m, f, done, start = len(g.n), Forest(len(g.n)), np.zeros(len(g.n), bool), 0
    while True:
        roots = f.roots()
        sizes = np.bincount(roots, minlength=m)
        big = int(sizes.argmax())
        todo = np.flatnonzero(~done & (roots != big)) if start else np.arange(min(m, 4))
        if start and not len(todo):
            return f.edges
        for p in todo[: max(4, start)].tolist():
            done[p] = True
            cand = g.candidates(p, ~done & (f.roots() != f.find(p)))
            while len(cand):
                got = g.links(p, cand[:CHUNK])
                f.join(np.full(len(got), p), got)
                cand = cand[CHUNK:]
                cand = cand[f.roots()[cand] != f.find(p)] if len(cand) else cand
        start = max(4, 2 * start)


def _verify(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        g = Group(pdf.n, [np.frombuffer(t, np.uint64) for t in pdf.tok], [np.frombuffer(t, np.int32) for t in pdf.freq], percent)
        rep = pdf.rep.to_numpy()
        return pd.DataFrame([(rep[a], rep[b]) for a, b in connect(g)], columns=["a", "b"]).astype("int64")

    return run


def _verify_large(sets: DataFrame, size: DataFrame, percent: int, queries: int, shingles: int) -> DataFrame:
    """Links inside groups too large for one task, enough to connect what they connect.

    sets: group, rep, n, tok, freq; size: group, count, shingles. A group's members are dealt into parts of about `queries`
    members and `shingles` shingles at most, and each two parts are a task.
    """
    parts = F.greatest(F.lit(2), F.ceil(F.col("count") / queries), F.ceil(F.col("shingles") / shingles)).cast("int")
    dealt = sets.join(size.select("group", parts.alias("parts")), "group").withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("own <> other")
    cells = met.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "n", "tok", "freq")
    return cells.repartition("group", "x", "y").groupBy("group", "x", "y").applyInPandas(_verify(percent), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, group_rows: int = GROUP_ROWS, queries: int = QUERIES, group_shingles: int = GROUP_SHINGLES, query_shingles: int = QUERY_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    buckets = max(64, 2 * parts)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    dealt = d.mapInArrow(partial(_first_prefixes, buckets=buckets, percent=percent), "bucket int, cnt binary, key binary, n binary, tok binary")
    counts = dealt.groupBy("bucket").applyInPandas(_repeated(buckets), "bucket int, key binary, cnt binary, n binary, known int")
    read = cut(counts.groupBy("bucket").applyInPandas(_survivors(percent), "doc_id long, n long, key binary, short long"))
    slim, left = read.where("n is not null").select("doc_id", "n", "key"), read.where("short is not null").select("short")

    classes = slim.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # the first eight bytes of a digest name a set in the packed arrays
    named = classes.withColumn("short", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long"))
    left = cut(named.join(left, "short", "left_semi").select("rep", "key"))

    texts = d.join(left, F.col("doc_id") == F.col("rep")).select("rep", "key", "text")
    every = texts.mapInArrow(partial(_all_shingles, buckets=buckets), "bucket int, tok binary, rep binary, n binary")
    shared = every.groupBy("bucket").applyInPandas(_frequencies(buckets), "bucket int, tok binary, rep binary, freq binary, n binary")
    sets = cut(shared.groupBy("bucket").applyInPandas(_assemble(percent), "rep long, n long, tok binary, freq binary, first array<long>"))

    pre = sets.select("rep", F.explode("first").alias("t"))
    star = pre.groupBy("t").agg(F.min("rep").alias("hub"), F.count("*").alias("k")).where("k > 1")
    loose = components(pre.join(star, "t").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    grouped = sets.drop("first").join(loose, F.col("rep") == F.col("node")).withColumnRenamed("root", "group").drop("node")
    size = cut(grouped.groupBy("group").agg(F.count("*").alias("count"), F.sum(F.octet_length("tok") / 8).alias("shingles")))
    fits = (F.col("count") <= group_rows) & (F.col("shingles") <= group_shingles)
    together = F.col("count") <= FEW_MEMBERS
    small = grouped.join(size.where(fits).select("group", together.alias("few"), F.when(together, F.pmod(F.xxhash64("group"), F.lit(buckets))).otherwise(F.col("group")).alias("call")), "group")
    edges = small.select("few", "call", "rep", "n", "tok", "freq").groupBy("few", "call").applyInPandas(_verify(percent), "a long, b long")
    if not (large := size.where(~fits)).isEmpty():
        edges = edges.union(_verify_large(grouped, large, percent, queries, query_shingles))
    linked = components(edges)

    of_class = classes.join(linked, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("root"))
    out = slim.join(of_class, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def _set_digest(batches):
    for b in batches:
        key = [xxhash.xxh3_128_digest(x.tobytes()) for _, x in _each(b, b.schema.names[-1])]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(key, pa.binary())], names=b.schema.names)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with one document of each component: the one with the smallest id. Rows without an id stay. Of rows that share
    an id and a set of shingles one stays, that of the least hash; rows of one id with other texts are other documents."""
    at, key = fresh(docs, "_other", "_set")
    gone = jaccard_components(docs, id_col, text_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(at)).distinct()
    kept = docs.join(gone, docs[id_col] == gone[at], "left_anti")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(at)).count().where("count > 1").select(at)
    if twice.isEmpty():
        return kept
    once, more = kept.join(twice, kept[id_col] == twice[at], "left_anti"), kept.join(twice, kept[id_col] == twice[at], "left_semi")
    with_key = more.withColumn(key, F.col(text_col)).mapInArrow(_set_digest, more.schema.add(key, "binary"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least_ = with_key.groupBy(id_col, key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return once.union(least_.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.* FROM s JOIN f USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
