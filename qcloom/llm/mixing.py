"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Whole copies that fit the target are certain; what is left of it is
filled by an order sample: each document draws a random odds u / (1 - u), divided by its inclusion odds
(the odds of the share that is left, times its size over the mean size, so that long documents are likelier),
and the documents with the smallest quotients are taken until the words that are left are used up.

Nothing is gathered per source: the cut-off of a source is found by a histogram of the quotient in 1,024
buckets, a second one of the bucket that the cut-off falls in, and a running sum over the rows of that
second bucket only (about a millionth of a source), so that a source with a third of all rows is no hot task.

Defined cases: null text or text without words has size 0 and takes nothing; a null source is a source of its
own, last in order; sources whose words sum to 0 have target 0; an empty table gives no rows; rows that repeat a
doc_id draw by their texts too, so that only rows with equal ids and texts share a draw (and are taken or left
together at the cut-off); a null doc_id draws as an empty id; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
BROADCAST_SOURCES = 50_000  # a plan of so many sources at most is broadcast (a few MB); more are joined by shuffle


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size in words, draw (52 bits of the digest of id and text)."""
    named = F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.conv(F.substring(F.sha2(named, 256), 1, 13), 16, 10).cast("long").alias("draw"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *([F.col(row).alias("row")] if row else []),
    )


def plan(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, n, target, whole (certain copies), left (words to sample), odds."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    level = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("spent", F.coalesce(F.sum("most").over(level), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("w").over(level), F.lit(0.0)))
    s = s.withColumn("rate", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("spent")) / (F.sum("w").over(everything) - F.col("gone")))
    s = s.withColumn("target", F.least("most", F.col("w") * F.max("rate").over(everything)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = s.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long")).withColumn("part", F.col("ratio") - F.floor("ratio"))
    return s.select(
        "source", "source_size", "n", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.when(F.col("part") > 0, F.col("part") / (F.lit(1.0) - F.col("part"))).alias("odds"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, whole_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies x size).

    With whole_rows, docs' own rows of which a copy or more is taken, with all their columns, and these:
    size, source_size, target, copies, taken (with underscores behind where docs has such a name).
    """
    sized = cut(sizes(docs, id_col, text_col, source_col))
    per = cut(plan(sized, weights, share, cap))
    small = per.count() <= BROADCAST_SOURCES

    def with_source(df: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("source", "_s")
        return df.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    u = (F.col("draw").cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    q = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (F.col("odds") * (F.col("size") / (F.col("source_size") / F.col("n"))))

    def drawn(rows: DataFrame) -> DataFrame:
        d = with_source(rows, per).withColumn("u", u)
        d = d.withColumn("q", F.when((F.col("size") > 0) & F.col("odds").isNotNull(), q))
        d = d.withColumn("v", F.coalesce(F.col("q") / (F.lit(1.0) + F.col("q")), F.lit(1.0)))
        d = d.withColumn("b1", F.floor(F.col("v") * BUCKETS).cast("int"))
        return d.withColumn("b2", F.floor((F.col("v") * BUCKETS - F.col("b1")) * BUCKETS).cast("int"))

    d = drawn(sized)
    live = d.where("q is not null")

    def crossing(rows: DataFrame, bucket: str, before: str) -> DataFrame:
        """The first bucket of each source in which the running sum reaches what is left, and the sum before it."""
        h = rows.groupBy("source", bucket).agg(F.sum("size").alias("x"), F.first("left").alias("left"), F.first(before).alias("base"))
        run = F.sum("x").over(Window.partitionBy("source").orderBy(bucket)) + F.col("base")
        return h.withColumn("run", run).where(F.col("run") >= F.col("left")).groupBy("source").agg(F.min(F.struct(bucket, (F.col("run") - F.col("x")).alias("start"))).alias("m")).select("source", f"m.{bucket}", "m.start")

    one = crossing(live.withColumn("zero", F.lit(0)), "b1", "zero").toDF("source", "c1", "start1")
    at1 = with_source(live, one).where("b1 = c1")
    two = cut(crossing(at1, "b2", "start1").toDF("source", "c2", "start2").join(one.withColumnRenamed("source", "_o"), F.col("source").eqNullSafe(F.col("_o"))).drop("_o"))
    rows = with_source(live, two).where("b1 = c1 and b2 = c2")
    line = Window.partitionBy("source").orderBy("v", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seen", F.coalesce(F.sum("size").over(line), F.lit(0)) + F.col("start2"))
    last = rows.where(F.col("seen") + F.col("size") / F.lit(2.0) <= F.col("left")).groupBy("source").agg(F.max(F.struct("v", F.col("doc_id").alias("i"))).alias("last"))
    ends = cut(two.join(last.withColumnRenamed("source", "_l"), F.col("source").eqNullSafe(F.col("_l")), "left").drop("_l"))
    if whole_rows:
        own = sizes(docs.withColumn(row := fresh(docs, "_row")[0], F.struct(*docs.columns)), id_col, text_col, source_col, row)
        d = drawn(own)
    d = with_source(d, ends)
    in_line = F.struct(F.col("v"), F.col("doc_id").alias("i")) <= F.col("last")
    picked = F.col("q").isNotNull() & (
        F.col("c1").isNull() | (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & ((F.col("b2") < F.col("c2")) | ((F.col("b2") == F.col("c2")) & F.coalesce(in_line, F.lit(False)))))
    )
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.when(picked, F.lit(1)).otherwise(F.lit(0))
    taken = (copies * F.col("size")).cast("long")
    if whole_rows:
        names = fresh(docs, "size", "source_size", "target", "copies", "taken")
        new = [F.col("size"), F.col("source_size"), F.col("target"), copies.cast("long"), taken]
        return d.where(copies > 0).select(F.col("row.*"), *(c.alias(n) for c, n in zip(new, names)))
    return d.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), taken.alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(sha256(concat(doc_id::VARCHAR, ' ', sha256(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
  2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, coalesce(sum(most) OVER q, 0) AS spent, coalesce(sum(w) OVER q, 0) AS gone FROM w
  WINDOW q AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - spent) / ((SELECT sum(w) FROM w) - gone) AS rate FROM l),
t AS (SELECT source, source_size, n, least(most, w * (SELECT max(rate) FROM r)) AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
f AS (SELECT source, source_size, n, target, floor(ratio)::BIGINT AS whole, target - floor(ratio)::BIGINT * source_size AS rest,
  CASE WHEN ratio - floor(ratio) > 0 THEN (ratio - floor(ratio)) / (1.0::DOUBLE - (ratio - floor(ratio))) END AS odds FROM p),
j AS (SELECT d.*, f.source_size, f.n, f.target, f.whole, f.rest,
  CASE WHEN size > 0 AND odds IS NOT NULL THEN (u / (1.0::DOUBLE - u)) / (odds * (size / (f.source_size / f.n))) END AS q
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
k AS (SELECT *, coalesce(sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY coalesce(q / (1.0::DOUBLE + q), 1), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM j)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN q IS NOT NULL AND seen + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM k
"""
