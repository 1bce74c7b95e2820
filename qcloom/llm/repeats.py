"""Suffix-array deduplication: every byte that lies in a string of SPAN bytes which starts anywhere else goes.

A suffix array of a whole corpus is one sorted list of all positions. This one is sparse and dealt out by content:

1. Anchors. Each window of SPAN bytes picks the least-hashed GRAM-byte string inside it, so that equal windows pick
   equal strings at equal offsets. Consecutive windows mostly share their anchor; a run of them, with the bytes they
   cover, is the anchor's context. Contexts of different anchors can't hold equal windows.
2. Equal contexts under one anchor are repeats as they are; a context alone under its anchor holds none. Only where an
   anchor has several contexts, of which one occurs once, are bytes needed.
3. Those contexts are sorted by what follows the anchor (the enhanced suffix array of one anchor: order and longest
   common prefixes). A stack scan over the prefixes lists the tree of intervals, each a set of ALL contexts that share R
   bytes from the anchor on. Inside an interval the bytes before the anchor, sorted backwards, tell how far each member
   goes on to the left with some other member; where the left sides are all one, the interval isn't maximal
   and its string is extended. A member whose left and right reach SPAN bytes together is a repeat there.
4. An anchor with more than GROUP contexts is never gathered: each window in its contexts is hashed by itself, and
   equal hashes are repeats. The result is the same.

Lengths can be told in words too (`words`): the text is then also read as the names of its words, WORD_BYTES of hash for
each, and the same steps find every string of so many words, however many bytes it has and whatever white space lies
between its words. Both lengths share one pass over the texts and one fetch of them. clean() cuts what either finds in
the texts as they came, with the white space between words that go.

Equal contexts are combined in the task that reads them: one of them is sent to the anchor's task, and the rest, known to
be repeats, straight to their texts. So a passage that a third of all documents share sends its anchors one entry a task.

Identical texts are one text with a count: two or more of them leave nothing of SPAN bytes or more. Positions, hashes
and ranges travel as packed arrays, one row per task and bucket; texts are moved once, only those with a repeated anchor
go on, compressed. Gram and window hashes have 64 bits; texts are named by the first 64 bits of their SHA-256.

Defined cases: a null text is empty; texts shorter than SPAN bytes keep everything; very long texts are read whole;
overlapping repeats inside one text count; repeated rows are other texts for each other; null ids are kept; an empty
table gives no rows; other columns, whatever their names, pass through clean() untouched. clean() returns text: where a
cut splits a character, the rest of that character goes too.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import _BYTE, NOT_SPACE, _pow, cut, flat, fresh, mix64, shuffle_parts, steps, words as words_of
from .decontaminate import with_length
from .ngramjoin import _of, _packed, _read

SPAN, GRAM = 400, 64
PASSAGE = 51  # words: passages of over 50
WORD_BYTES = 8
GROUP = 20_000
FLUSH = 500_000
_LOW31 = np.uint64((1 << 31) - 1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position on, by doubling."""
    h, size = _BYTE[buf], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9DDFEA08EB382D69) + h[size:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        size *= 2
    return h ^ (h >> np.uint64(29))


def span_hash(grams: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """A hash of the `span` bytes from each of the positions on."""
    x = np.zeros(len(at), np.uint64)
    for k in [*range(0, span - GRAM, GRAM), span - GRAM]:
        x = mix64(x + grams[at + k])
    return x


def least_in_window(v: np.ndarray, w: int) -> np.ndarray:
    """Least of v[i : i + w] for every i up to len(v) - w."""
    n = len(v)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    block = full.reshape(-1, w)
    fore = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def anchors(buf: np.ndarray, offs: np.ndarray, span: int):
    """Runs of windows of the texts that share an anchor: text number, anchor, first and last window, anchor's hash,
    context's hash. Positions are in buf."""
    none = tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(buf) < span:
        return none
    g = gram_hashes(buf)
    key = ((g * np.uint64(0x9E3779B97F4A7C15)) & ~_LOW31) | np.arange(len(g), dtype=np.uint64)
    q = (least_in_window(key, span - GRAM + 1) & _LOW31).astype(np.int64)  # of the leftmost least gram
    fits = np.ones(len(q), bool)
    for e in offs[1:-1]:  # windows that would cross into the next text
        fits[max(0, e - span + 1) : e] = False
    p = np.flatnonzero(fits)
    if not len(p):
        return none
    new = np.ones(len(p), bool)
    new[1:] = (q[p[1:]] != q[p[:-1]]) | (p[1:] != p[:-1] + 1)
    first = p[new]
    last = p[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)]
    x = q[first]
    ctx = mix64(mix64(span_hash(g, first, span)) + span_hash(g, last, span) + (last - first).astype(np.uint64))
    return np.searchsorted(offs, first, side="right") - 1, x, first, last, g[x], ctx


def short_name(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)


def word_stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as names of their words, case kept, end to end, and their offsets."""
    starts, ends, _, first = words_of(buf, offs, NOT_SPACE, hashes=False)
    if not len(starts):
        return np.empty(0, np.uint8), first.astype(np.int64)
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    h = np.add.reduceat(_BYTE[buf[place + np.repeat(starts, size)]] * _pow(int(size.max()))[place], begin)
    return mix64(h + size.astype(np.uint64)).view(np.uint8), first.astype(np.int64) * WORD_BYTES


def word_ranges(raw: bytes, r: np.ndarray) -> np.ndarray:
    """Ranges of a word stream as ranges of the text's bytes; part of a name, alike by chance, is no word."""
    starts, ends, _, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_SPACE, hashes=False)
    a, e = -(-r[:, 0] // WORD_BYTES), r[:, 1] // WORD_BYTES
    return np.stack([starts[a], ends[e - 1]], 1)


def _concat(held: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(z) for z in zip(*held)]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of each run of equal values."""
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []
    return list(zip(edge, [*edge[1:], len(x)]))


def _blank(got: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """got with all of names, empty where it has no such column."""
    have, none = got.schema.names, pa.array([b""] * got.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([got.column(have.index(c)) if c in have else none for c in names], names=names)


ANCHORS = ["bucket", "a", "c", "t", "x", "lo", "hi", "many"]
WINDOWS = ["bucket", "w", "t", "x", "many"]


def _anchor_rows(batches, spans: list[int], buckets: int):
    """Packed by anchor: anchor's hash, context's hash, text, place, bytes before the anchor at most and at least, and
    whether this task has the context several times. One entry goes for all equal contexts of a task; the others are known
    to be repeats and go on by text (buckets from 2 * `buckets` on), so that a common passage is no hot anchor."""
    held, total = [[] for _ in spans], 0

    def flush():
        for u, rows in enumerate(held):
            if not rows:
                continue
            a, c, t, x, lo, hi = _concat(rows)
            order = np.lexsort((x, t, c, a))
            a, c, t, x, lo, hi = (z[order] for z in (a, c, t, x, lo, hi))
            new_c = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
            new = new_c | np.append(True, (t[1:] != t[:-1]) | (x[1:] != x[:-1]))  # copies of a text say the same
            a, c, t, x, lo, hi, new_c = (z[new] for z in (a, c, t, x, lo, hi, new_c))
            ctx = np.cumsum(new_c) - 1
            many = np.bincount(ctx)[ctx] > 1
            k = new_c
            yield _packed(ANCHORS[1:], [a[k], c[k], t[k], x[k], lo[k], hi[k], many[k].astype(np.int8)], u * buckets + _of(a[k], buckets), 4 * buckets)
            if many.any():
                k = many
                yield _blank(_packed(["t", "x", "lo", "hi"], [t[k], x[k], lo[k], hi[k]], (2 + u) * buckets + _of(t[k].view(np.uint64), buckets), 4 * buckets), ANCHORS)

    off = _off(spans)
    for b in batches:
        for _, _, raw, at in steps(b, "text"):
            names: dict[int, int] = {}
            for u, span in enumerate(spans):
                buf, offs = word_stream(raw, at) if u else (raw, at)
                text, x, first, last, a, c = anchors(buf, offs, span)
                if not len(x):
                    continue
                have, back = np.unique(text, return_inverse=True)
                for k in have.tolist():
                    if k not in names:
                        names[k] = short_name(raw[at[k] : at[k + 1]].tobytes())
                name = np.array([names[k] for k in have.tolist()], np.int64)[back]
                held[u].append((a, c, name, (x - offs[text]).astype(np.int64), (x - last).astype(off), (x - first).astype(off)))
                total += len(x)
            if total >= FLUSH:
                yield from flush()
                held, total = [[] for _ in spans], 0
    yield from flush()


def _off(spans: list[int]):
    return np.int16 if max(spans) < 32768 else np.int32


SORTED = ["bucket", "kind", "a", "t", "x", "size", "lo", "hi", "flag"]


def _sorted_out(spans: list[int], buckets: int, group: int):
    """Packed by text: kind 0, ranges that are repeats (place, length); kind 1, contexts whose bytes are needed; kind 2
    those of anchors with too many; 3, 4 and 5 the same in words. flag: this context occurs once."""
    off = _off(spans)

    def ranges(u, t, x, lo, hi):
        got = _packed(["t", "x", "size"], [t, x - hi, hi.astype(np.int32) - lo + spans[u]], _of(t.view(np.uint64), buckets), buckets)
        return _blank(got, [c for c in SORTED if c != "kind"]).to_pandas().assign(kind=3 * u)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        direct, u = divmod(int(pdf.bucket.iloc[0]) // buckets, 2)
        t, x, lo, hi = _read(pdf, t=np.int64, x=np.int64, lo=off, hi=off)
        if direct:
            return ranges(u, t, x, lo, hi)[SORTED]
        a, c, many = _read(pdf, a=np.uint64, c=np.uint64, many=np.int8)
        order = np.lexsort((-many, x, t, c, a))
        a, c, t, x, lo, hi, many = (z[order] for z in (a, c, t, x, lo, hi, many))
        keep = np.ones(len(a), bool)  # copies of a text say the same
        keep[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (t[1:] != t[:-1]) | (x[1:] != x[:-1])
        a, c, t, x, lo, hi, many = (z[keep] for z in (a, c, t, x, lo, hi, many))
        new_a = np.append(True, a[1:] != a[:-1])
        new_c = new_a | np.append(True, c[1:] != c[:-1])
        ctx, anc = np.cumsum(new_c) - 1, np.cumsum(new_a) - 1
        times = np.bincount(ctx, 1 + many)[ctx]
        kinds = np.bincount(anc[new_c])[anc]
        alone = np.bincount(anc, times == 1)[anc] > 0
        r = times > 1
        out = [ranges(u, t[r], x[r], lo[r], hi[r])]
        for kind, rows in ((1, kinds <= group), (2, kinds > group)):
            r = rows & new_c & alone & (kinds > 1)
            arrays = [a[r], t[r], x[r], lo[r], hi[r], (times[r] == 1).astype(np.int8)]
            got = _packed(["a", "t", "x", "lo", "hi", "flag"], arrays, _of(t[r].view(np.uint64), buckets), buckets)
            out.append(_blank(got, [c for c in SORTED if c != "kind"]).to_pandas().assign(kind=3 * u + kind))
        return pd.concat(out)[SORTED]

    return run


def _per_text(spans: list[int]):
    """One row for each text: its ranges of either length and the contexts it is asked for."""
    off = _off(spans)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[dict[int, bytes]] = []
        for u in (0, 1):
            t, x, size = _read(pdf[pdf.kind == 3 * u], t=np.int64, x=np.int64, size=np.int32)
            order = np.argsort(t, kind="stable")
            t, r = t[order], np.stack([x, x + size], 1)[order]
            found.append({int(t[i]): merged(r[i:j]).tobytes() for i, j in _runs(t)})
        parts = []
        for kind in (1, 2, 4, 5):
            got = _read(pdf[pdf.kind == kind], t=np.int64, a=np.uint64, x=np.int64, lo=off, hi=off, flag=np.int8)
            parts.append((*got, np.full(len(got[0]), kind, np.int8)))
        t, *more = _concat(parts)
        order = np.argsort(t, kind="stable")
        t, more = t[order], [z[order] for z in more]
        asked = {int(t[i]): tuple(z[i:j].tobytes() for z in more) for i, j in _runs(t)}
        rows = [(k, found[0].get(k, b""), found[1].get(k, b""), *asked.get(k, (b"",) * 6)) for k in sorted({*found[0], *found[1], *asked})]
        return pd.DataFrame(rows, columns=["t", "ranges", "wranges", "a", "x", "lo", "hi", "flag", "kind"])

    return run


def merged(r: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges that cover the same (touching ones are joined)."""
    if not len(r):
        return r.reshape(0, 2).astype(np.int64)
    r = r[np.argsort(r[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.append(True, r[1:, 0] > reach[:-1])
    return np.stack([r[new, 0], np.append(reach[:-1][new[1:]], reach[-1])], 1).astype(np.int64)


def _pack(batches, names: list[str]):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        z = pa.array([pack(x.as_py().encode()) for x in b.column(b.schema.get_field_index("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), z], names=[*names, "z"])


def _unpack():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _asked(batches, spans: list[int], k: int):
    """For each text that is asked for contexts of kind k or 3 + k: length's number, text, its stream, and the contexts'
    anchors, places, bytes before the anchor at least and at most, flags."""
    off, unpack = _off(spans), _unpack()
    for b in batches:
        col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            kind = np.frombuffer(col["kind"][i].as_py(), np.int8)
            raw = None
            for u in range(len(spans)):
                if (mine := kind == 3 * u + k).any():
                    raw = raw if raw is not None else unpack(col["z"][i].as_py())
                    stream = word_stream(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes() if u else raw
                    yield u, col["t"][i].as_py(), stream, *(np.frombuffer(col[c][i].as_py(), d)[mine] for c, d in (("a", np.uint64), ("x", np.int64), ("lo", off), ("hi", off), ("flag", np.int8)))


def _contexts(batches, spans: list[int], buckets: int):
    """Packed by anchor: contexts with their bytes end to end."""
    held, texts, total = [], [], 0

    def flush():
        u, a, t, x, lo, hi, flag = _concat(held)
        deal = u * buckets + _of(a, buckets)
        got = _packed(["a", "t", "x", "lo", "hi", "flag"], [a, t, x, lo, hi, flag], deal, 2 * buckets)
        order = np.argsort(deal, kind="stable")
        text = [b"".join([texts[k] for k in order[i:j].tolist()]) for i, j in _runs(deal[order])]
        return pa.RecordBatch.from_arrays([*got.columns, pa.array(text, pa.binary())], names=[*got.schema.names, "bytes"])

    for u, t, raw, a, x, lo, hi, flag in _asked(batches, spans, 1):
        held.append((np.full(len(a), u), a, np.full(len(a), t, np.int64), x, lo, hi, flag))
        texts += [raw[p - h : p - m + spans[u]] for p, m, h in zip(x.tolist(), lo.tolist(), hi.tolist())]
        total += int((hi.astype(np.int64) - lo + spans[u]).sum())
        if total >= 8 << 20:
            yield flush()
            held, texts, total = [], [], 0
    if held:
        yield flush()


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    d = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (d.bit_length() + 7) // 8


def intervals(lcp: list[int]):
    """All intervals of the common-prefix tree by a stack scan: (length, first, last). lcp[i] is between i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > here:
            length, first = stack.pop()
            yield length, first, i - 1
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def solve(texts: list[bytes], lo, hi, span: int) -> list[tuple[int, int, int]]:
    """Repeats among contexts of one anchor: (context, least, most bytes before the anchor at which a window that also
    occurs in another context starts)."""
    m = len(texts)
    right = [t[h:] for t, h in zip(texts, hi)]
    left = [t[:h][::-1] for t, h in zip(texts, hi)]
    if m == 2:
        r, n = common(*right), common(*left)
        return [(i, max(span - r, lo[i]), min(n, hi[i])) for i in (0, 1) if max(span - r, lo[i]) <= min(n, hi[i])]
    suffixes = sorted(range(m), key=right.__getitem__)
    lcp = [0] + [common(right[i], right[j]) for i, j in zip(suffixes, suffixes[1:])]
    before = sorted(range(m), key=left.__getitem__)
    ext = np.array([common(left[i], left[j]) for i, j in zip(before, before[1:])] + [0])
    rank = np.empty(m, np.int64)
    rank[before] = np.arange(m)
    before, at, out = np.array(before), np.array(suffixes), []
    for r, first, last in intervals(lcp):
        member = np.sort(rank[at[first : last + 1]])
        reach = np.minimum.reduceat(ext, member)[:-1]  # left extension that neighbours share: diverse where it's short
        if r + reach.max(initial=0) < span:
            continue
        n = np.maximum(np.append(reach, 0), np.append(0, reach))
        for k in np.flatnonzero(n >= span - r).tolist():
            i = int(before[member[k]])
            a, b = max(span - r, lo[i]), min(int(n[k]), hi[i])
            if a <= b:
                out.append((i, a, b))
    return out


def _solved(spans: list[int], buckets: int):
    off = _off(spans)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = int(pdf.bucket.iloc[0]) // buckets
        span = spans[u]
        a, t, x, lo, hi, flag = _read(pdf, a=np.uint64, t=np.int64, x=np.int64, lo=off, hi=off, flag=np.int8)
        raw = b"".join(pdf["bytes"])
        size = hi.astype(np.int64) - lo + span
        end = np.cumsum(size)
        order = np.lexsort((x, t, a))
        same = np.append(False, (a[order][1:] == a[order][:-1]) & (t[order][1:] == t[order][:-1]) & (x[order][1:] == x[order][:-1]))
        order = order[~same]
        ts, ps, ns = [], [], []
        for i, j in _runs(a[order]):
            if j - i < 2:
                continue
            k = order[i:j]
            texts = [raw[e - s : e] for e, s in zip(end[k].tolist(), size[k].tolist())]
            for c, least, most in solve(texts, lo[k].tolist(), hi[k].tolist(), span):
                if flag[k[c]]:
                    ts.append(t[k[c]])
                    ps.append(x[k[c]] - most)
                    ns.append(most - least + span)
        ts = np.array(ts, np.int64)
        return _packed(["t", "x", "size"], [ts, np.array(ps, np.int64), np.array(ns, np.int32)], _of(ts.view(np.uint64), buckets), buckets).to_pandas().assign(u=u)[FOUND]

    return run


FOUND = ["bucket", "u", "t", "x", "size"]


def _windows(batches, spans: list[int], buckets: int):
    """Packed by hash: every window of the contexts of anchors with too many; one entry for equal windows of a task, and
    the others by text, as in _anchor_rows."""
    held, total = [], 0

    def flush():
        u, w, t, x = _concat(held)
        order = np.lexsort((x, t, w, u))
        u, w, t, x = u[order], w[order], t[order], x[order]
        new_w = np.append(True, (w[1:] != w[:-1]) | (u[1:] != u[:-1]))
        at = np.cumsum(new_w) - 1
        many = np.bincount(at)[at] > 1
        k = new_w
        yield _packed(WINDOWS[1:], [w[k], t[k], x[k], many[k].astype(np.int8)], u[k] * buckets + _of(w[k], buckets), 4 * buckets)
        if many.any():
            k = many
            yield _blank(_packed(["t", "x"], [t[k], x[k]], (2 + u[k]) * buckets + _of(t[k].view(np.uint64), buckets), 4 * buckets), WINDOWS)

    for u, t, raw, _, x, lo, hi, _ in _asked(batches, spans, 2):
        p = np.unique(np.concatenate([np.arange(q - h, q - m + 1) for q, m, h in zip(x.tolist(), lo.tolist(), hi.tolist())]))
        held.append((np.full(len(p), u), span_hash(gram_hashes(np.frombuffer(raw, np.uint8)), p, spans[u]), np.full(len(p), t, np.int64), p))
        total += len(p)
        if total >= FLUSH:
            yield from flush()
            held, total = [], 0
    if held:
        yield from flush()


def _equal_windows(spans: list[int], buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        direct, u = divmod(int(pdf.bucket.iloc[0]) // buckets, 2)
        t, x = _read(pdf, t=np.int64, x=np.int64)
        if not direct:
            w, many = _read(pdf, w=np.uint64, many=np.int8)
            order = np.lexsort((-many, x, t, w))
            w, t, x, many = w[order], t[order], x[order], many[order]
            new = np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1]) | (x[1:] != x[:-1]))
            w, t, x, many = w[new], t[new], x[new], many[new]
            at = np.cumsum(np.append(True, w[1:] != w[:-1])) - 1
            some = np.bincount(at, 1 + many)[at] > 1
            t, x = t[some], x[some]
        return _packed(["t", "x", "size"], [t, x, np.full(len(t), spans[u], np.int32)], _of(t.view(np.uint64), buckets), buckets).to_pandas().assign(u=u)[FOUND]

    return run


def _more(pdf: pd.DataFrame) -> pd.DataFrame:
    found: list[dict[int, bytes]] = []
    for u in (0, 1):
        t, x, size = _read(pdf[pdf.u == u], t=np.int64, x=np.int64, size=np.int32)
        order = np.argsort(t, kind="stable")
        t, r = t[order], np.stack([x, x + size], 1)[order]
        found.append({int(t[i]): merged(r[i:j]).tobytes() for i, j in _runs(t)})
    return pd.DataFrame([(k, found[0].get(k), found[1].get(k)) for k in sorted({*found[0], *found[1]})], columns=["t2", "more", "wmore"])


def _finish(batches):
    """t, merged ranges of bytes and of the word stream, bytes removed, runs removed, SHA-256 of what stays, words in
    repeated strings of words."""
    unpack = _unpack()
    for b in batches:
        t, z, *parts = (b.column(k) for k in range(6))
        out = []
        for i in range(b.num_rows):
            r, w = (merged(np.concatenate([np.frombuffer(x[i].as_py() or b"", np.int64).reshape(-1, 2) for x in parts[u::2]])) for u in (0, 1))
            raw, h, at = unpack(z[i].as_py()), hashlib.sha256(), 0
            for a, e in r.tolist():
                h.update(raw[at:a])
                at = e
            h.update(raw[at:])
            out.append((r.tobytes(), w.tobytes(), int((r[:, 1] - r[:, 0]).sum()), len(r), h.hexdigest(), int((w[:, 1] // WORD_BYTES + -w[:, 0] // WORD_BYTES).sum())))
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        arrays = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([t, *arrays], names=["t", "spans", "word_spans", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, its SHA-256 and length, its short name t, and a key k that isn't null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    d = d.withColumn("t", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long"))
    return d.withColumn("k", F.coalesce("doc_id", "t"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, group: int = GROUP, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, sha, n_bytes, n_words, t, whole, whole_words) and, for each distinct text with repeats that
    occurs once, (t, spans, word_spans, n_removed, n_spans, kept_sha256, n_passage_words). Texts that occur twice or more
    are marked by whole if they have span bytes or more, by whole_words if they have `words` words or more.

    words: look for strings of so many words too; else n_words is 0. n_removed, n_spans and kept_sha256 are of bytes."""
    spans = [span] if words is None else [span, words * WORD_BYTES]
    if min(spans) < GRAM:
        raise ValueError(f"span must be {GRAM} bytes or more, words {GRAM // WORD_BYTES} or more")
    least = span if words is None else min(span, 2 * words - 1)
    buckets = max(64, 2 * shuffle_parts(docs.sparkSession))
    d = _named(docs, id_col, text_col)
    count = F.lit(0) if words is None else F.when(F.col("n_bytes") >= 2 * words - 1, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0)
    slim = cut(d.withColumn("n_words", count.cast("long")).drop("text"))
    long_, long_words = F.col("n_bytes") >= span, F.lit(False) if words is None else F.col("n_words") >= words
    texts = slim.where(long_ | long_words).groupBy("sha", "t").agg(F.min("k").alias("k"), F.count("*").alias("copies"))
    binaries = lambda names: ", ".join(f"{c} binary" for c in names)
    dealt = d.select("text").where(F.octet_length("text") >= least).mapInArrow(partial(_anchor_rows, spans=spans, buckets=buckets), f"bucket int, {binaries(ANCHORS[1:])}")
    sorted_out = dealt.groupBy("bucket").applyInPandas(_sorted_out(spans, buckets, group), f"bucket int, kind int, {binaries(SORTED[2:])}")
    names = ["ranges", "wranges", "a", "x", "lo", "hi", "flag", "kind"]
    per = sorted_out.groupBy("bucket").applyInPandas(_per_text(spans), f"t long, {binaries(names)}")
    # a text that occurs twice is only needed for the contexts it is asked for
    per = cut(per.join(texts, "t").where((F.col("copies") == 1) | (F.octet_length("a") > 0)).drop("sha"))
    names = ["t", "copies", *names]
    fetched = d.select("k", "t", "text").join(per, ["k", "t"])
    fetched = cut(fetched.mapInArrow(partial(_pack, names=names), f"t long, copies long, {binaries(names[2:])}, z binary"))
    found = (
        fetched.mapInArrow(partial(_contexts, spans=spans, buckets=buckets), f"bucket int, {binaries(['a', 't', 'x', 'lo', 'hi', 'flag', 'bytes'])}")
        .groupBy("bucket").applyInPandas(_solved(spans, buckets), f"bucket int, u int, {binaries(FOUND[2:])}")
    )
    large = (
        fetched.mapInArrow(partial(_windows, spans=spans, buckets=buckets), f"bucket int, {binaries(WINDOWS[1:])}")
        .groupBy("bucket").applyInPandas(_equal_windows(spans, buckets), f"bucket int, u int, {binaries(FOUND[2:])}")
    )
    more = found.union(large).groupBy("bucket").applyInPandas(_more, "t2 long, more binary, wmore binary")
    once = fetched.where("copies = 1").select("t", "z", "ranges", "wranges").join(more, F.col("t") == F.col("t2"), "left").select("t", "z", "ranges", "wranges", "more", "wmore")
    done = cut(once.mapInArrow(_finish, "t long, spans binary, word_spans binary, n_removed long, n_spans long, kept_sha256 string, n_passage_words long").where("n_spans > 0 or n_passage_words > 0"))
    both = texts.where("copies > 1").select("sha", F.lit(True).alias("twice"))
    twice = F.coalesce("twice", F.lit(False))
    return slim.drop("k").join(both, "sha", "left").withColumn("whole", twice & long_).withColumn("whole_words", twice & long_words).drop("twice"), done


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: words in strings of PASSAGE words or more that occur anywhere else."""
    slim, done = repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), words=PASSAGE)
    pick = lambda c, all_, none: F.when(F.col("whole"), all_).otherwise(F.coalesce(c, none))
    return slim.join(done.drop("spans", "word_spans"), "t", "left").select(
        "doc_id", "n_bytes", pick("n_removed", F.col("n_bytes"), F.lit(0)).cast("long").alias("n_removed"), pick("n_spans", F.lit(1), F.lit(0)).cast("long").alias("n_spans"),
        pick("kept_sha256", F.sha2(F.lit(""), 256), F.col("sha")).alias("kept_sha256"),
        F.when(F.col("whole_words"), F.col("n_words")).otherwise(F.coalesce("n_passage_words", F.lit(0))).alias("n_passage_words"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, group: int = GROUP, words: int | None = None) -> DataFrame:
    """docs with the repeated bytes cut out of their texts, and with `words` repeated strings of so many words too; texts
    of which nothing but white space stays go, those that had none before stay. n_chars, where there is such a column,
    follows the text."""
    t, t2, spans, word_spans, whole = fresh(docs, "_text", "_name", "_spans", "_word_spans", "_whole")
    slim, done = repeats(docs, id_col, text_col, span, group, words)
    no = F.lit(None).cast("binary")
    twice = slim.where("whole or whole_words").select(F.col("t").alias(t2), no.alias(spans), no.alias(word_spans), F.lit(True).alias(whole)).distinct()
    names = done.select(F.col("t").alias(t2), F.col("spans").alias(spans), F.col("word_spans").alias(word_spans), F.lit(False).alias(whole)).union(twice)
    d = docs.withColumn(t, F.conv(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 16), 16, -10).cast("long"))
    cols = list(docs.columns)

    def cutter(batches):
        for b in batches:
            k = b.schema.get_field_index(text_col)
            text = b.column(k)
            sp, wsp = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (spans, word_spans))
            keep = np.ones(b.num_rows, bool)
            if any(sp) or any(wsp):
                out = text.to_pylist()
                for i, (s, w) in enumerate(zip(sp, wsp)):
                    if s or w:
                        raw = out[i].encode()
                        r = np.frombuffer(s or b"", np.int64).reshape(-1, 2)
                        if w:
                            r = merged(np.concatenate([r, word_ranges(raw, np.frombuffer(w, np.int64).reshape(-1, 2))]))
                        at = [0, *r.reshape(-1).tolist(), len(raw)]
                        out[i] = "".join(raw[a:e].decode(errors="ignore") for a, e in zip(at[::2], at[1::2]))
                        keep[i] = bool(out[i].strip())
                text = pa.array(out, text.type)
            got = pa.RecordBatch.from_arrays([text if i == k else b.column(i) for i in range(len(cols))], names=cols)
            yield got.filter(pa.array(keep))

    kept = d.join(names, F.col(t) == F.col(t2), "left").where(~F.coalesce(F.col(whole), F.lit(False))).select(*cols, spans, word_spans)
    return with_length(kept.mapInArrow(cutter, docs.schema), text_col)
