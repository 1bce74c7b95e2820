"""Entry points: a batch run over a work list, resuming it, looking into inputs and results, accuracy."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import taxonomy
from ..operators import report, state, worklist
from ..operators.record import assemble
from ..operators.validate import normalize
from ..sources import readers, sinks, snapshots, state_log


def open_run_state(spark: SparkSession, items: DataFrame, root: str, fresh: bool = False) -> tuple[str, str, str | None]:
    """(run id, fingerprint, a finished run of the same list). An unfinished run of this list is gone on with."""
    mark = worklist.fingerprint(items).first().fingerprint
    manifests = readers_manifest(spark, root).where(F.col("fingerprint") == mark)
    log = state_log.states(spark, root, [r.run_id for r in manifests.select("run_id").collect()])  # the runs of one list
    again = None if fresh else state.find_resumable(manifests, log, mark)
    return again or time.strftime("%Y%m%d-%H%M%S-") + mark[:6], mark, state.find_completed(manifests, log, mark)


def readers_manifest(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/manifest"
    return sinks.read_manifest(spark, path) if snapshots.versions(spark, path) else spark.createDataFrame([], state.MANIFEST)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df written, and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_qc(items: DataFrame, extracts: DataFrame, scorer: Callable[[DataFrame], DataFrame], root: str, kind: str, sink_names: list[str] = ["qc"], fresh: bool = False, limit: int | None = None) -> dict:  # noqa: B006
    """Run the items that aren't done: extracts (id, ok, error, name, hits, …) through the scorer and the validator to
    records, sinks and the state log. scorer: extract rows -> raw output rows with id (validate.RAW), vision_ok, judge_invoked.

    Items without an extract row become ERROR records. Returns run id, counts and whether the list is complete. The list and
    what is to be done of it are written first, so that the text that they come from is parsed once, however often they are read.
    """
    spark = items.sparkSession
    own = f"{root}/stage-{uuid.uuid4().hex}"
    try:
        return _run(_kept(items.select("id", "type", "line_no", "pos"), f"{own}/items"), extracts, scorer, root, own, kind, sink_names, fresh, limit)
    finally:
        snapshots.delete(spark, own)


def _run(items: DataFrame, extracts: DataFrame, scorer: Callable[[DataFrame], DataFrame], root: str, own: str, kind: str, sink_names: list[str], fresh: bool, limit: int | None) -> dict:
    spark = items.sparkSession
    run_id, mark, finished = open_run_state(spark, items, root, fresh)
    todo = state.pending_items(items, state_log.current(spark, root, run_id))
    if limit is not None:
        todo = worklist.limit_items(todo, limit)
    todo = _kept(todo.select("id", "line_no", "pos"), f"{own}/todo")
    now = time.time()
    stored = f"{root}/items/{run_id}"  # the list, as a table: it may have any length
    if not readers.exists(spark, f"{stored}/_SUCCESS"):
        items.write.mode("overwrite").parquet(stored)
    row = items.agg(F.count("*").cast("int").alias("total_items")).select(
        F.lit(run_id).alias("run_id"), F.lit(mark).alias("fingerprint"), "total_items", F.lit("").alias("input_path"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("array<struct<id:string,type:string>>").alias("items"),
    )
    sinks.write_manifest(row, f"{root}/manifest")

    found = todo.join(extracts, "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    raw = scorer(found.where("ok"))
    valid, rejected = normalize(raw)
    found = found.join(rejected.select("id", F.col("error").alias("validation_error")), "id", "left")
    rec = assemble(found, valid, kind, run_id).withColumn("seq", F.struct("line_no", "pos"))
    sinks.record_checkpoint(rec, f"{root}/records")
    done = spark.read.parquet(f"{root}/records").where(F.col("run_id") == run_id)
    sinks.multi_sink(done, sink_names, f"{root}/{run_id}")
    new = done.join(todo.select("id"), "id", "left_semi")
    sinks.append_state(state.state_rows(new, run_id, state.DONE, now, F.lit(int(now * 1000)), F.nullif("error", F.lit(""))), f"{root}/state")
    log = state_log.fold(spark, root, run_id)
    n, total = state.done_count(log).first().done, items.count()
    return {"run_id": run_id, "done": n, "total": total, "remaining": max(total - n, 0), "complete": n >= total, "finished_before": finished}


def resume_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """What a run still has to do, from its own stored list: the table beside the manifest, or the manifest's own list."""
    if readers.exists(spark, f"{root}/items/{run_id}/_SUCCESS"):
        items = spark.read.parquet(f"{root}/items/{run_id}")
    else:
        m = readers_manifest(spark, root).where(F.col("run_id") == run_id)
        items = m.select(F.posexplode("items").alias("pos", "i")).select(F.col("i.id").alias("id"), F.col("i.type").alias("type"), F.lit(0).cast("long").alias("line_no"), "pos")
    return state.pending_items(items, state_log.current(spark, root, run_id))


def inspect_input(items: DataFrame, rejects: DataFrame, n: int = 5) -> dict[str, DataFrame]:
    """Counts, an estimate and some ids of a work list; nothing is run."""
    return {"report": worklist.parse_report(items, rejects), "estimate": worklist.plan_estimate(items), "sample": worklist.limit_items(items, n).select("id"), "rejects": rejects}


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    newest = state.list_runs(readers_manifest(spark, root))
    return state.list_runs(state.run_progress(newest, state_log.states(spark, root, [r.run_id for r in newest.select("run_id").collect()])))


def show_results(spark: SparkSession, run_dir: str, only: str | None = None) -> dict:
    df, schema = readers.load_run_frame(spark, run_dir)
    if df is None:
        raise FileNotFoundError(f"no results in {run_dir}")
    return report.show_results(df, schema, only)


def show_taxonomy(spark: SparkSession) -> DataFrame:
    return taxonomy(spark)


def accuracy(spark: SparkSession, pred: str, gold: str, fields: str | None = None, out: str | None = None) -> DataFrame:
    got = report.accuracy(readers.load_labels(spark, gold), readers.load_labels(spark, pred), fields)
    if out:
        sinks.accuracy_report(got, out)
    return got
