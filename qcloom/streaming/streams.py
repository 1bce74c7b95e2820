"""Streams: QC rows from a landing folder, and the stress level of an event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.record import keep_last
from ..sources import snapshots


def read_landing(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Files as they land, at most so many at a time (the bounded queue). path: a folder, or one file of a folder."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.load(path)
    return stream.option("pathGlobFilter", p.getName()).load(p.getParent().toString())


def qc_stream(source: DataFrame, to_rows: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Rows of every batch under out/batch=<id>. A batch that is run again after a loss overwrites its own folder, and the
    checkpoint keeps finished files from being read again, so that a restart neither redoes nor repeats rows."""

    def write(batch: DataFrame, n: int) -> None:
        to_rows(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, out: str, key: str, seq: str | None = None) -> DataFrame:
    """The last row of each key over all batches. (dropDuplicates on the stream would keep the first.)"""
    d = spark.read.parquet(out)
    d = d.withColumn("_at", F.struct("batch", F.col(seq)) if seq else F.struct("batch"))
    return keep_last(d, key, "_at").drop("_at", "batch")


def upsert_stream(source: DataFrame, to_rows: Callable[[DataFrame], DataFrame], table: str, key: str, checkpoint: str, seq: str | None = None) -> StreamingQuery:
    """The last row of each key in a snapshot table, of which each batch writes only the buckets that it touches. The batch's number
    is committed with its rows, so that a batch that is run again after a loss does nothing."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        meta = snapshots.head(spark, table)
        if meta and meta["extra"].get("batch", -1) >= n:
            return
        rows = to_rows(batch)
        rows = keep_last(rows, key, seq) if seq else rows.groupBy(key).agg(*[F.last(c).alias(c) for c in rows.columns if c != key]).select(*rows.columns)
        newer = (lambda old, new: keep_last(old.unionByName(new), key, seq)) if seq else None
        snapshots.upsert(rows, table, [key], newer, extra={"batch": n})

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stress_level(events: DataFrame, ts: str, key: str | None = None, seconds: int = 300) -> DataFrame:
    """events with `level`: how many there were in the last `seconds`, both ends included.

    Without a key the log is cut into buckets of `seconds`: each event is counted against its own bucket and the one
    before, so that no window spans the log.
    """
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    if key:
        w = Window.partitionBy(key).orderBy("_s").rangeBetween(-seconds, 0)
        return events.withColumn("_s", sec).withColumn("level", F.count("*").over(w)).drop("_s")
    d = events.withColumn("_s", sec).withColumn("_b", F.floor(F.col("_s") / seconds))
    n = d.groupBy("_b", "_s").agg(F.count("*").alias("n"))
    both = n.select(F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"), "_s", "n")
    w = Window.partitionBy("_b").orderBy("_s").rangeBetween(-seconds, 0)
    own = both.withColumn("level", F.sum("n").over(w)).where(F.floor(F.col("_s") / seconds) == F.col("_b")).select("_s", "level")
    return d.drop("_b").join(own, "_s").drop("_s")


def alert_tier(level: Column, start: int, least: int) -> Column:
    """A budget that falls by one for every event after the first, to `least`. Stateless: it recovers with the level."""
    return F.when(level >= 2, F.greatest(F.lit(least), F.lit(start) - (level - 1))).otherwise(F.lit(start))


def stress_windows(events: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", counts: Column | None = None) -> DataFrame:
    """Events per sliding window of a live log, with a watermark for late ones (stateful.stress_state has the exact level of each
    event). counts: which events count; the others only move the watermark."""
    n = F.count_if(F.lit(True) if counts is None else counts)
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide)).agg(n.alias("level")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "level")
