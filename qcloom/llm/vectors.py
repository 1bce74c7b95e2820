"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with cosine c or more lie within squared distance D = 2 - 2c. After an orthonormal rotation (principal
axes of a bounded sample, dealt round-robin, so that every block begins with a wide axis) a vector is cut into
BLOCKS low-dimensional blocks. The squared budget D is shared among the blocks in proportion to their variance, and a
pair within D must be within its share in at least one block. Each block is range-joined on its own: cells of the
width of the block's radius along its first axis or axes, a vector at home in one cell and visiting the neighbours
on one side; inside a cell pairs within the block's budget are found in sorted windows, and those of which this is
the first such block are verified by the exact cosine in double precision. So every pair is counted exactly once.

What is dealt out is the rotated vector in single precision. Cosines that it leaves open, those within DOUBT of the
bound, are computed again from the vectors as they came; all others are far enough from it to be decided.

Exact copies are collapsed to one representative with a count first. No pairs but those in doubt leave a task: it returns
link counts and the edges of a spanning forest, so that dense groups cost rows in proportion to their size. As a label
grows, its cells are cut along more axes. Cells are counted before anything is dealt out, and one of more than TASK_ROWS
rows is many tasks: its rows are split into parts by hash, and each two parts meet in a task of their own.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, and one with a null label, links
with nothing (n_links 0, its own component), nor does one with a null vec_id (n_links 0, no component); vectors of different length never link; rows that repeat a vec_id, with
equal or other vectors and labels, are vectors of their own, counted and joined as such; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import components, cut

COSINE, BLOCKS = 0.93, 4
SAMPLE = 4096  # vectors that the rotation is fitted on; any rotation gives the same links
CELL_ROWS = 200_000  # a label of more vectors gets cells along two axes, of ten times as many along three
TASK_ROWS = 50_000  # rows of a cell that are one task
SLACK = 1e-5
DOUBT = 2e-6  # more than single precision can be off in a cosine of unit vectors, see _margin
STEP = 512


def _margin(dim: int) -> float:
    """How far from the bound a cosine in single precision has to be: rounding of both vectors and of the sum."""
    return max(DOUBT, 4 * (dim + 2) * 2.0**-24)


def _unit(batches):
    """label, digest of the vector, dimension, unit vector (float64 bytes); null digest where it can't link."""
    for b in batches:
        ids, labels, vecs = b.column(0), b.column(1).to_pylist(), b.column(2)
        vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
        dig, dim, out = [], [], []
        for label, v in zip(labels, vecs):
            x = v.values
            d = None
            if label is not None and x is not None and len(x) and not x.null_count:
                a = x.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(a).max()
                if np.isfinite(top) and top > 0:
                    d = hashlib.blake2b(a.tobytes(), digest_size=16).digest()
                    a = a / top  # against overflow and underflow of the norm
                    a = a / np.sqrt(np.dot(a, a))
            dig.append(d)
            dim.append(len(a) if d else 0)
            out.append(a.tobytes() if d else None)
        yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(dim, pa.int32()), pa.array(dig, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "digest", "v"])


class Space:
    """The rotation of one dimension, its blocks' shares of the budget and their radii."""

    def __init__(self, sample: np.ndarray, dim: int, cosine: float, blocks: int) -> None:
        m = min(blocks, dim)
        self.width = -(-dim // m)
        self.blocks = m
        x = sample - sample.mean(0) if len(sample) else np.zeros((1, dim))
        var, axes = np.linalg.eigh(x.T @ x / max(len(x), 1) + 1e-12 * np.eye(dim))
        var, axes = var[::-1], axes[:, ::-1]
        place = [[k for k in range(b, dim, m)] for b in range(m)]
        self.rotation = np.zeros((dim, m * self.width))  # short blocks end in zeros
        share = np.zeros(m)
        for b, ks in enumerate(place):
            self.rotation[:, b * self.width : b * self.width + len(ks)] = axes[:, ks]
            share[b] = var[ks].clip(1e-9).sum()
        share = 0.5 * share / share.sum() + 0.5 / m  # in proportion, but no block without a share
        self.budget = (2 - 2 * cosine) * share * (1 + SLACK) + 1e-12
        self.radius = np.sqrt(self.budget)


def _cells(p: pd.DataFrame, spaces: dict[int, Space], many: dict[tuple[str, int], int]):
    """For each dimension, number of axes and block: rows of p, their rotated vectors, cells as text, and whether that is
    home, else a neighbour on one side. many: labels whose cells are cut along more axes than one."""
    for dim, part in p.groupby("dim"):
        s = spaces[dim]
        axes = np.array([min(many.get((x, dim), 1), s.width) for x in part.label])
        for n in np.unique(axes).tolist():
            mine = part[axes == n]
            r = np.stack([np.frombuffer(v) for v in mine.v]) @ s.rotation
            steps = np.array(np.meshgrid(*[[-1, 0, 1]] * n, indexing="ij")).reshape(n, -1).T
            steps = [x for x in steps.tolist() if x >= [0] * n]  # home, and one of each two opposite neighbours
            for k in range(s.blocks):
                cell = np.floor(r[:, k * s.width : k * s.width + n] / s.radius[k]).astype(np.int64)
                for step in steps:
                    yield mine, r, k, [",".join(map(str, c)) for c in (cell + step).tolist()], not any(step)


def _count(spaces: dict[int, Space], many: dict):
    """Rows of each cell."""

    def run(batches):
        for b in batches:
            for mine, _, k, at, _ in _cells(b.to_pandas(), spaces, many):
                got = pd.DataFrame({"label": mine.label.to_numpy(), "dim": mine.dim.to_numpy(), "cell": at}).groupby(["label", "dim", "cell"], as_index=False).size()
                yield pa.RecordBatch.from_arrays([pa.array(got.label), pa.array(got.dim, pa.int32()), pa.array([k] * len(got), pa.int32()), pa.array(got.cell), pa.array(got["size"], pa.int64())], names=["label", "dim", "block", "cell", "size"])

    return run


def _deal(spaces: dict[int, Space], many: dict):
    """Rows of every vector for every block: its home cell, and the cells it visits on one side of it."""

    def run(batches):
        for b in batches:
            last = None
            for mine, r, k, at, home in _cells(b.to_pandas(), spaces, many):
                if last is not r:
                    last, raw = r, pa.array([x.tobytes() for x in r.astype(np.float32)], pa.binary())
                label, dim, rep, n = (pa.array(mine[c].to_numpy(), kind) for c, kind in (("label", pa.string()), ("dim", pa.int32()), ("rep", pa.int64()), ("n", pa.int64())))
                yield pa.RecordBatch.from_arrays([label, dim, pa.array([k] * len(at), pa.int32()), pa.array(at, pa.string()), rep, n, pa.array([home] * len(at)), raw], names=["label", "dim", "block", "cell", "rep", "n", "home", "v"])

    return run


class Forest:
    """Union-find that remembers the edges which joined two trees."""

    def __init__(self, n: int) -> None:
        self.p, self.edges = np.arange(n), []

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def roots(self) -> np.ndarray:
        while True:
            q = self.p[self.p]
            if (q == self.p).all():
                return q
            self.p = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        r = self.roots()
        far = r[a] != r[b]
        for x, y in zip(a[far].tolist(), b[far].tolist()):
            s, t = self.find(x), self.find(y)
            if s != t:
                self.p[max(s, t)] = min(s, t)
                self.edges.append((x, y))


def _cell(spaces: dict[int, Space], cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        if len(pdf) < 2:
            return empty
        dim, k, across = int(pdf.dim.iloc[0]), int(pdf.block.iloc[0]), int(pdf.one.iloc[0]) != int(pdf.two.iloc[0])
        s, doubt = spaces[dim], _margin(dim)
        v = np.frombuffer(b"".join(pdf.v), np.float32).reshape(len(pdf), -1)
        lo = k * s.width
        second = lo + 1 if s.width > 1 else lo
        order = np.argsort(v[:, second], kind="stable")
        v, home, rep, n, part = v[order], pdf.home.to_numpy()[order], pdf.rep.to_numpy()[order], pdf.n.to_numpy()[order], pdf.part.to_numpy()[order]
        x = np.ascontiguousarray(v[:, lo : lo + s.width])
        sq, key = (x * x).sum(1), v[:, second]
        links, forest, open_ = np.zeros(len(v), np.int64), Forest(len(v)), []
        at = np.flatnonzero(home)
        for i in range(0, len(at), STEP):
            mine = at[i : i + STEP]
            a = np.searchsorted(key, key[mine[0]] - s.radius[k] - 1e-6, "left")
            b = np.searchsorted(key, key[mine[-1]] + s.radius[k] + 1e-6, "right")
            for j in range(a, b, 4 * STEP):
                other = np.arange(j, min(b, j + 4 * STEP))
                d = sq[mine][:, None] + sq[other][None] - 2 * (x[mine] @ x[other].T)
                near = d <= s.budget[k] + 1e-5
                near &= ~home[other][None] | (other[None] > mine[:, None])
                if across:  # pairs inside a part meet where it meets itself
                    near &= part[mine][:, None] != part[other][None]
                p, q = np.nonzero(near)
                for c in range(0, len(p), 8 * STEP):
                    e, f = mine[p[c : c + 8 * STEP]], other[q[c : c + 8 * STEP]]
                    diff = ((v[e] - v[f]) ** 2).reshape(len(e), s.blocks, s.width).sum(2)
                    first = (diff <= s.budget).argmax(1) == k
                    cos = (v[e] * v[f]).sum(1, dtype=np.float64)
                    good = first & (diff[:, k] <= s.budget[k]) & (cos >= cosine - doubt)
                    sure = cos[good] >= cosine + doubt
                    e, f = e[good], f[good]
                    open_.append(np.stack([rep[e[~sure]], rep[f[~sure]]], 1))
                    e, f = e[sure], f[sure]
                    np.add.at(links, e, n[f])
                    np.add.at(links, f, n[e])
                    forest.join(e, f)
        got = np.flatnonzero(links)
        one = pd.DataFrame({"a": rep[got], "b": rep[got], "links": links[got]})
        two = pd.DataFrame([(rep[x], rep[y], 0) for x, y in forest.edges], columns=["a", "b", "links"])
        ask = np.concatenate([np.empty((0, 2), np.int64), *open_])
        three = pd.DataFrame({"a": ask[:, 0], "b": ask[:, 1], "links": -1})
        return pd.concat([one, two, three]).astype("int64") if len(got) or len(ask) else empty

    return run


def _exact(batches):
    """a, b, their counts and the cosine of their vectors as they came."""
    for b in batches:
        cos = [float(np.dot(np.frombuffer(x), np.frombuffer(y))) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cos, pa.float64())], names=["a", "b", "na", "nb", "cos"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = cut(src.mapInArrow(_unit, "vec_id long, label string, dim int, digest binary, v binary"))
    live = rows.where("digest is not null and vec_id is not null")
    classes = live.groupBy("label", "digest", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # ids may repeat in other classes
    counts = cut(classes.groupBy("label", "dim").count())
    large = counts.where(F.col("count") > cell_rows).collect()  # at most a row for every cell_rows vectors
    many = {(r.label, r.dim): 2 + (r["count"] > 10 * cell_rows) for r in large}
    spaces = {}
    for r in counts.select("dim").distinct().collect():  # a row for each dimension
        sample = classes.where(F.col("dim") == r.dim).orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("v").collect()
        spaces[r.dim] = Space(np.stack([np.frombuffer(x.v) for x in sample]), r.dim, cosine, blocks)
    keys = ["label", "dim", "block", "cell"]
    wide = counts.where(F.col("count") > task_rows).select("label", "dim")  # a cell of another label can't be dense
    dense = None
    if not wide.isEmpty():  # a row for every task_rows vectors at most
        slim = classes.select("label", "dim", "v").join(F.broadcast(wide), ["label", "dim"], "left_semi")
        dense = slim.mapInArrow(_count(spaces, many), "label string, dim int, block int, cell string, size long").groupBy(*keys).agg(F.sum("size").alias("size")).where(F.col("size") > task_rows)
        dense = cut(dense.withColumn("parts", F.ceil(2 * F.col("size") / task_rows).cast("int")).drop("size"))
    dealt = classes.select("label", "dim", "rep", "n", "v").mapInArrow(_deal(spaces, many), "label string, dim int, block int, cell string, rep long, n long, home boolean, v binary")
    if dense is None or dense.isEmpty():
        dealt = dealt.withColumns({"part": F.lit(0), "one": F.lit(0), "two": F.lit(0)})
    else:  # a row for every task_rows rows at most
        dealt = dealt.join(dense, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), "parts"), F.lit(0)).cast("int"))
        dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumns({"one": F.least("part", "with"), "two": F.greatest("part", "with")}).drop("parts", "with")
    found = cut(dealt.groupBy(*keys, "one", "two").applyInPandas(_cell(spaces, cosine), "a long, b long, links long"))
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("v").alias(f"v{k}"))
    asked = found.where("links < 0").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb")
    exact = cut(asked.mapInArrow(_exact, "a long, b long, na long, nb long, cos double").where(F.col("cos") >= cosine))
    both = exact.select(F.explode(F.array(F.struct("a", F.col("nb").alias("links")), F.struct(F.col("b").alias("a"), F.col("na").alias("links")))).alias("x")).select("x.*")
    links = found.where("links > 0").select("a", "links").union(both).groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("links = 0").select("a", "b").union(exact.select("a", "b")))
    least = joined.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("first"))
    joined = joined.join(least, "root").select("node", "first")
    of_class = classes.select("label", "digest", "dim", "rep", "n", "least")
    of_class = of_class.join(links, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    of_class = cut(of_class.select("label", "digest", "dim", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("first", "least").alias("root")))
    out = rows.drop("v").join(of_class, ["label", "digest", "dim"], "left")
    root = F.coalesce("root", "vec_id")
    named = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(named, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, root).alias("component_id"), (F.col("vec_id") == root).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.root, vec_id)::BIGINT AS component_id, vec_id = coalesce(c.root, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""
