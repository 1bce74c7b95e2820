"""Runs: what is done, what is left, which run a work list belongs to. Tables: state, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "run_id string, item_id string, stage string, ts double, seq long, error string"
MANIFEST = "run_id string, fingerprint string, total_items int, input_path string, created_at double, updated_at double, items array<struct<id:string,type:string>>"
DONE = "SUNK"


def latest_stage(state: DataFrame, *by: str) -> DataFrame:
    """The last stage of every item (of each run, if `by` has run_id)."""
    return state.groupBy(*by, "item_id").agg(F.max_by("stage", "seq").alias("stage"))


def done_count(state: DataFrame, *by: str) -> DataFrame:
    last = latest_stage(state, *by)
    return last.groupBy(*by).agg(F.count_if(F.col("stage") == DONE).alias("done"))


def pending_items(items: DataFrame, state: DataFrame, key: str = "id", retry_errors: bool = False) -> DataFrame:
    """items that aren't done. retry_errors: those that ended in an error count as not done."""
    last = state.groupBy("item_id").agg(F.max_by(F.struct("stage", "error"), "seq").alias("m"))
    done = last.where(F.col("m.stage") == DONE)
    if retry_errors:
        done = done.where(F.coalesce("m.error", F.lit("")) == "")
    return items.join(done, items[key] == done["item_id"], "left_anti")


def run_progress(manifests: DataFrame, state: DataFrame) -> DataFrame:
    """run_id, total_items, done, remaining, unfinished."""
    done = done_count(state, "run_id")
    d = manifests.join(done, "run_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return d.withColumn("remaining", F.greatest(F.col("total_items") - F.col("done"), F.lit(0))).withColumn("unfinished", F.col("done") < F.col("total_items"))


def manifest_match(manifests: DataFrame, state: DataFrame, fingerprint: str) -> DataFrame:
    return run_progress(manifests.where(F.col("fingerprint") == fingerprint), state)


def _newest(runs: DataFrame) -> str | None:
    got = runs.agg(F.max(F.struct("updated_at", "run_id")).alias("m")).select("m.run_id").first()
    return got[0] if got else None


def find_resumable(manifests: DataFrame, state: DataFrame, fingerprint: str) -> str | None:
    """The newest unfinished run of this work list."""
    return _newest(manifest_match(manifests, state, fingerprint).where("unfinished"))


def find_completed(manifests: DataFrame, state: DataFrame, fingerprint: str) -> str | None:
    return _newest(manifest_match(manifests, state, fingerprint).where("not unfinished"))


def list_runs(progress: DataFrame, n: int = 15) -> DataFrame:
    return progress.orderBy(F.desc("run_id")).limit(n)


def next_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """New manifest rows: the first created_at stays, and a stored list is never dropped."""
    o = old.select("run_id", F.col("created_at").alias("_c"), F.col("items").alias("_i"))
    d = new.join(o, "run_id", "left")
    return d.withColumn("created_at", F.coalesce("_c", "updated_at")).withColumn("items", F.coalesce("items", "_i")).drop("_c", "_i")


def state_rows(items: DataFrame, run_id: str, stage: str, ts: float, seq: Column, error: Column | None = None) -> DataFrame:
    e = F.substring(error, 1, 500) if error is not None else F.lit(None).cast("string")
    return items.select(F.lit(run_id).alias("run_id"), F.col("id").alias("item_id"), F.lit(stage).alias("stage"), F.lit(float(ts)).alias("ts"), seq.cast("long").alias("seq"), e.alias("error"))
