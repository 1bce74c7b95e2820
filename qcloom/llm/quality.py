"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = b + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The second part is every pairwise interaction of low rank, in time linear in the features by the sum-of-squares
identity. Features of a text: its lower-cased words hashed to WORDS buckets (unit length), and statistics of its
structure and its metadata (length in bytes), each cut into BINS bins that overlap linearly.

Fitting takes at most `per_class` labelled rows of each class, those with the smallest hash of their id (a documented
bound), weighted back to the classes' true sizes, and runs in one task over that bounded table. Scoring is a narrow
pass over whole texts.

Defined cases: null and empty texts have no words and the statistics of emptiness, and are scored like any other; very
long texts are read whole; repeated rows score alike; rows whose label is null or whose text is missing teach nothing;
with labels of one class, or none, the score is that class's smoothed share; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import NOT_SPACE, small_batches, steps, words
from .langid import held_out

WORDS, BINS, RANK = 2048, 8, 8
PER_CLASS = 4000
EPOCHS, BATCH, RATE, DECAY = 14, 128, 0.02, 1e-4
CUT = 0.3
#: (lower, upper) of each statistic; between them BINS linear bins
STATS = [(0, 14), (0, 10), (0, 1), (0, 0.3), (0, 0.5), (0, 0.5), (0, 0.5), (2, 14), (0, 1), (0, 0.5), (0, 1), (0, 8)]
SIZE = WORDS + len(STATS) * BINS

_UP, _DIG, _PUN, _SYM = (np.array([f(chr(c)) for c in range(256)], np.float32) for f in (lambda x: "A" <= x <= "Z", lambda x: "0" <= x <= "9", lambda x: x in ".,;:!?", lambda x: x in "#$%&*|@^~=+<>{}[]\\/_"))
_ALPHA = np.array([chr(c).isalpha() and c < 128 for c in range(256)], np.float32)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of SIZE numbers for each text."""
    n = len(offs) - 1
    x = np.zeros((n, SIZE), np.float32)
    starts, ends, h, first = words(buf, offs, NOT_SPACE)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    bytes_ = np.diff(offs)

    def total(table_: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0.0], np.cumsum(table_[buf], dtype=np.float64)])
        return s[offs[1:]] - s[offs[:-1]]

    letters = np.maximum(total(_ALPHA), 1)
    size = np.maximum(bytes_, 1)
    lines = total((np.arange(256) == 10).astype(np.float32)) + 1
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, owner))
        ho, oo = h[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])]))
        runs = np.diff(np.append(new, len(ho)))
        distinct = np.bincount(oo[new], minlength=n)
        np.maximum.at(top, oo[new], runs)
        bag = np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        bag = np.sqrt(bag).astype(np.float32)
        x[:, :WORDS] = bag / np.maximum(np.sqrt((bag**2).sum(1, keepdims=True)), 1)
    w = np.maximum(count, 1)
    repeated = np.zeros(n)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        repeated = np.bincount(owner[1:][same], minlength=n)
    wide = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = (wide[offs[1:]] - wide[offs[:-1]]).clip(1)
    stats = [
        np.log1p(bytes_), np.log1p(count), total(_UP) / letters, total(_DIG) / size, total(_PUN) / w / 2,
        total(_SYM) / w / 2, (bytes_ - chars) / chars, chars / w, distinct / w, top / w, repeated / w, np.log1p(count / lines),
    ]
    for k, (s, (lo, hi)) in enumerate(zip(stats, STATS)):
        at = np.clip((s - lo) / (hi - lo), 0, 1) * (BINS - 1)
        left = np.minimum(at.astype(int), BINS - 2)
        row, col = np.arange(n), WORDS + k * BINS + left
        x[row, col] = 1 - (at - left)
        x[row, col + 1] = at - left
    return x


class Machine:
    def __init__(self, bias: float, w: np.ndarray | None = None, v: np.ndarray | None = None) -> None:
        self.bias, self.w, self.v = bias, w, v

    def margin(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.bias)
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s).sum(1) - (x * x) @ (self.v * self.v).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> Machine:
    """Adam on the weighted logistic loss, in a fixed order of minibatches."""
    share = float((weight * y).sum() + 1) / float(weight.sum() + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Machine(bias)
    rng = np.random.default_rng(seed)
    p = [np.array([bias], np.float32), np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)]
    m, q, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = (weight / weight.mean()).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            i = order[lo : lo + BATCH]
            xb, s = x[i], x[i] @ p[2]
            z = p[0][0] + xb @ p[1] + 0.5 * ((s * s).sum(1) - (xb * xb) @ (p[2] * p[2]).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)).astype(np.float32)
            xg = xb * g[:, None]
            grads = [np.array([g.sum()], np.float32), xb.T @ g + DECAY * p[1], xb.T @ (s * g[:, None]) - p[2] * (xg * xb).sum(0)[:, None] + DECAY * p[2]]
            t += 1
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                q[k] = 0.999 * q[k] + 0.001 * grads[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(float(p[0][0]), p[1], p[2])


def _rows(text_col: str, keep: list[str], make):
    """mapInArrow function: keep's columns and what make(bytes, offsets) gives for each text."""

    def run(batches):
        for batch in batches:
            parts = []
            for i, j, buf, offs in steps(batch, text_col):
                for lo in range(0, j - i, 512):
                    o = offs[lo : min(lo + 512, j - i) + 1]
                    parts.append(make(buf[o[0] : o[-1]], o - o[0]))
            yield [batch.column(batch.schema.get_field_index(c)) for c in keep], parts

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Machine:
    """Fit on at most per_class labelled rows of each class."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(id_col).alias("i")).distinct(), "i", "left_semi")
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Machine(0.0)
    part = None
    for y, n in sorted(totals.items()):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class).withColumn("w", F.lit(n / min(n, per_class)))
        part = one if part is None else part.union(one)
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(part), "i")  # 2 x per_class ids
    # of an id with several texts one teaches, whichever way the table is cut: a row an id and task is what is shuffled
    sample = sample.groupBy("i", "y", "w").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m")).select("i", "y", "w", "m.t")

    def sparse(batches):
        make = _rows("t", ["i", "y", "w"], features)
        for cols, parts in make(batches):
            out = []
            for x in parts:
                for r in x:
                    at = np.flatnonzero(r)
                    out.append(at.astype(np.uint16).tobytes() + r[at].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], names=["i", "y", "w", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.mapInArrow(sparse, f"i {kind}, y int, w double, x binary")

    def one_task(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i")
        x = np.zeros((len(pdf), SIZE), np.float16)
        for k, b in enumerate(pdf["x"]):
            n = len(b) // 4
            x[k, np.frombuffer(b[: 2 * n], np.uint16)] = np.frombuffer(b[2 * n :], np.float16)
        return pd.DataFrame({"m": [pickle.dumps(train(Half(x), pdf.y.to_numpy(np.float32), pdf.w.to_numpy(np.float32)))]})

    got = rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(one_task, "m binary").collect()  # one bounded group
    return pickle.loads(got[0].m) if got else Machine(0.0)


class Half:
    """Rows kept in half precision, read in single."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, i) -> np.ndarray:
        return self.x[i].astype(np.float32)


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the chance of label 1, for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        make = _rows("t", ["doc_id"], lambda b, o: shared.value.score(features(b, o)))
        for cols, parts in make(batches):
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = spread(docs)
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
