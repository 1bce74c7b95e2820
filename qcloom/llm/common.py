"""Helpers that several text operators share: scratch space, byte-level word scanning, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- session


def scratch(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's shared folder, or a folder of our own where none is named and all is one machine."""
    small_batches(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-qcloom-"))


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python workers by the thousand, unless the session says otherwise: with Spark's
    default of ten thousand the Arrow buffers on both sides take hundreds of MB where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder once and go on from what was written."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it back: for wide rows."""
    scratch(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of names."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


# --------------------------------------------------------------------------- bytes and words

CHUNK = 1 << 18  # bytes of text that one vectorised step handles; longer single texts are a step of their own


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len(texts) + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def steps(batch: pa.RecordBatch, text_col: str):
    """Cut a batch into row ranges of about CHUNK bytes: (first row, last row + 1, bytes, offsets)."""
    buf, offs = flat(batch.column(batch.schema.get_field_index(text_col)))
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def table(allowed) -> np.ndarray:
    """256 booleans: which byte belongs to a word."""
    return np.array([bool(allowed(c)) for c in range(256)])


NOT_SPACE = table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D)
LETTER_DIGIT = table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray, hashes: bool = True):
    """Words of the texts: byte starts, byte ends, 64-bit hashes, and the first word's number for each text.

    A word is a longest run of bytes in `member`, after A-Z are lower-cased; it never crosses texts.
    """
    low = LOWER[buf]
    inside = member[low]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offs)
    if not hashes:
        return starts, ends, None, first
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64), first
    at = np.flatnonzero(inside)
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(begin, size)
    h = np.add.reduceat(_BYTE[low[at]] * _pow(int(size.max()))[place], begin)
    return starts, ends, mix64(h + size.astype(np.uint64)), first


# --------------------------------------------------------------------------- components


EDGES_IN_ONE_TASK = 100_000  # so many edges, a MB or two, take one task instead of rounds of jobs


def _united(pdf):
    """(node, root) of the components of (u, v) edges, by union-find."""
    import pandas as pd

    nodes, ends = np.unique(np.concatenate([pdf["u"], pdf["v"]]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(ends[: len(pdf)].tolist(), ends[len(pdf) :].tolist()):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": nodes, "root": nodes[[find(x) for x in range(len(nodes))]]})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of (a, b) edges over longs: (node, root), root the smallest node reachable.

    Large-star/small-star contraction, round by round until it settles (some log n squared rounds at most); few edges (counted first) are united in one task. Every round is a few hash aggregations on edges, each node's edges are
    reduced with min() before any shuffle, and lineage is cut by checkpoint after each round. Nodes without
    edges aren't returned; null ends are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    e = cut(e)
    if e.limit(EDGES_IN_ONE_TASK + 1).count() <= EDGES_IN_ONE_TASK:
        return e.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_united, "node long, root long")
    while True:
        # every node of larger neighbours points them at the smallest node around it
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        # and each node points its smaller neighbours, and itself, at the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = (
            down.join(low.where("k > 1"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        new = cut(small)
        # a star forest: no node that is pointed at points on
        if new.select(F.col("v").alias("u")).distinct().join(new.select("u").distinct(), "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            e = new
            break
        e = new
    pairs = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.union(roots)
