"""The state log of runs: appended by run, folded into a snapshot of each item's last row from time to time.

Appends are JSON lines below run_id=<run>/, so that a run's state reads its own folder alone. fold() upserts the last row of every
item of the files that aren't folded yet into the run's snapshot; the snapshot's version file names those files in
the same commit, so that a row is read from one of the two whenever a writer breaks off. What was folded before the last
snapshot is deleted with the next, so that neither the log nor the list grows with the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import STATE
from . import snapshots
from .readers import read_state_log

NEWEST = ("seq", "ts", "stage", "error")  # by which an item's last row is found


def _run(spark: SparkSession, root: str, run_id: str) -> tuple[str, str]:
    """Folders of a run's log and of its snapshot."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
    return f"{root}/state/run_id={name}", f"{root}/state_snapshots/{name}"


def append(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").partitionBy("run_id").json(f"{root}/state")


def _files(spark: SparkSession, log: str) -> list[str]:
    return [n for n in snapshots.names(spark, log) if not n.startswith(("_", "."))]


def _tail(spark: SparkSession, root: str, run_id: str, names: list[str]) -> DataFrame:
    log, _ = _run(spark, root, run_id)
    if not names:
        return spark.createDataFrame([], STATE)
    d = spark.read.schema(STATE).option("mode", "DROPMALFORMED").json([f"{log}/{n}" for n in names])
    return d.withColumn("run_id", F.lit(run_id)).where("item_id is not null and stage is not null")


def current(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Rows that hold every item's last: the snapshot's and those of the files that it hasn't folded."""
    log, snap = _run(spark, root, run_id)
    files = _files(spark, log)  # first: files that a fold deletes meanwhile are in its snapshot
    meta = snapshots.head(spark, snap)
    if meta is None:
        return _tail(spark, root, run_id, files)
    old = snapshots.read(spark, snap, meta["version"]).withColumn("run_id", F.lit(run_id))
    return old.unionByName(_tail(spark, root, run_id, [n for n in files if n not in set(meta["extra"]["folded"])]))


def fold(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Take the log's new files into the run's snapshot. Returns the snapshot."""
    log, snap = _run(spark, root, run_id)
    meta = snapshots.head(spark, snap)
    done = meta["extra"]["folded"] if meta else []
    files = [n for n in _files(spark, log) if n not in set(done)]

    def last(d: DataFrame) -> DataFrame:
        return d.groupBy("item_id").agg(F.max(F.struct(*NEWEST)).alias("m")).select("item_id", "m.stage", "m.ts", "m.seq", "m.error")

    out = snapshots.upsert(last(_tail(spark, root, run_id, files)), snap, ["item_id"], lambda old, new: last(old.unionByName(new)), extra={"folded": files})
    for n in done:
        snapshots.delete(spark, f"{log}/{n}")
    return out


def states(spark: SparkSession, root: str, run_ids: list[str] | None = None) -> DataFrame:
    """State rows of some runs, or of all that have a log."""
    if run_ids is None:
        unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        run_ids = [unescape(n.split("=", 1)[1]) for n in snapshots.names(spark, f"{root}/state") if n.startswith("run_id=")]
    snaps = [r for r in run_ids if snapshots.versions(spark, _run(spark, root, r)[1])]
    plain = [r for r in run_ids if r not in set(snaps)]
    out = spark.createDataFrame([], STATE)
    if plain and snapshots.names(spark, f"{root}/state"):
        out = read_state_log(spark, f"{root}/state").where(F.col("run_id").isin(plain)).select(*out.columns)
    for r in snaps:
        out = out.unionByName(current(spark, root, r).select(*out.columns))
    return out
