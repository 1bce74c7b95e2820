"""Sinks. Files are written beside the old ones and put in their place when they are whole; tables are snapshots.py's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import QC_COLUMNS
from ..operators.record import flatten_record, keep_last, qc_row
from ..operators.state import next_manifest
from . import snapshots
from .readers import read_csv, settle


def _rename(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"can't rename {old} to {new}")


def _swap(df: DataFrame, path: str, write) -> None:
    """Write beside path, then put it in path's place. Of a writer that breaks off between the renames, the next reader
    or writer finishes the work: see readers.settle."""
    spark = df.sparkSession
    settle(spark, path)
    own = uuid.uuid4().hex[:8]
    P = spark._jvm.org.apache.hadoop.fs.Path
    now, new, old = P(path), P(f"{path}.{own}.new"), P(f"{path}.{own}.old")
    write(df, new.toString())
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(now):
        _rename(fs, now, old)
    _rename(fs, new, now)
    fs.delete(old, True)


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(path)


def qc_output(rec: DataFrame, path: str, seq: str = "seq") -> DataFrame:
    """The twelve columns, the last row of each Channel ID, as CSV. Returns what was written, read back: all strings."""
    rows = keep_last(qc_row(rec, seq), "Channel ID", seq).select(*[F.col(f"`{c}`") for c in QC_COLUMNS])
    _swap(rows, path, _csv)
    return read_csv(rec.sparkSession, path)


def wide_results(rec: DataFrame, path: str, seq: str = "seq") -> DataFrame:
    rows = flatten_record(keep_last(rec, "id", seq).drop(seq))
    kinds = [f.name for f in rows.schema.fields if f.dataType.simpleString().startswith(("struct", "map", "array"))]
    rows = rows.withColumns({k: F.to_json(k) for k in kinds}) if kinds else rows
    _swap(rows, path, _csv)
    return read_csv(rec.sparkSession, path)


def record_checkpoint(rec: DataFrame, path: str) -> None:
    """Whole records, unguarded, by run."""
    rec.write.mode("append").partitionBy("run_id").parquet(path)


def append_state(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("run_id").json(path)


def write_manifest(new: DataFrame, path: str) -> DataFrame:
    """The manifest table with these runs' rows new or replaced; only their buckets are written. Returns it, read back."""

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        m = next_manifest(old, rows)
        return old.join(m.select("run_id"), "run_id", "left_anti").unionByName(m.select(*old.columns))

    if not snapshots.versions(new.sparkSession, path):
        return snapshots.replace(next_manifest(new.limit(0), new).select(*new.columns), path, ["run_id"], 16)
    return snapshots.upsert(new, path, ["run_id"], merge)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read(spark, path)


def accuracy_report(metrics: DataFrame, path: str) -> None:
    """(field, accuracy) rows as one CSV row of metric columns."""
    one = metrics.groupBy().pivot("field").agg(F.first("accuracy"))
    _swap(one, path, _csv)


SINKS = {"qc": qc_output, "csv": wide_results}
NAMES = {"qc": "qc_output", "csv": "results"}


def build_sinks(names: list[str]) -> list[str]:
    for n in names:
        if n not in SINKS:
            raise ValueError(f"unknown sink {n!r}; there are {sorted(SINKS)}")
    return names


def multi_sink(rec: DataFrame, names: list[str], folder: str, seq: str = "seq") -> None:
    """Every record to every sink named; computed once. One sink alone reads its columns only, and nothing is held for it."""
    build_sinks(names)
    several = len(names) > 1
    rec = rec.persist() if several else rec
    try:
        for n in names:
            SINKS[n](rec, f"{folder}/{NAMES[n]}", seq)
    finally:
        if several:
            rec.unpersist()
