"""Tables that are replaced or upserted whole or not at all, writing only the buckets that change.

A table is a folder. data/<id>/bucket=<k>/ holds Parquet files; versions/<n>.json says which data folder each bucket is read
from. A commit writes data first and its version file last, under a passing name that is then renamed to one that must not exist
yet. So a writer that breaks off leaves the table as it was, readers of the old version aren't disturbed, and of two writers
that started from one version the second finds its name taken and starts again. A row's bucket is the hash of its key; an
upsert reads and writes the buckets that its rows fall in, the others stay where they are. vacuum() deletes what no kept
version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16  # of small tables; one of billions of keys takes thousands
FEW_KEYS = 500_000  # keys asked for, some 100 bytes each, that are broadcast
TRIES = 5  # times that an upsert starts again after another writer's commit
NAME = "{:012d}.json"


class Taken(RuntimeError):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Of a folder's files and folders; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in names(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit()]


def head(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What the last version's file says, or that of a version; None if there is no table."""
    have = versions(spark, path)
    if not have:
        return None
    fs, p = _fs(spark, f"{path}/versions/{NAME.format(have[-1] if version is None else version)}")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, meta: dict) -> None:
    """Make meta the version that it says it is. Raises Taken if there is one already."""
    fs, tmp = _fs(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{NAME.format(meta['version'])}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(tmp).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(final), none)
    except Exception as e:
        fs.delete(tmp, False)
        if fs.exists(final):
            raise Taken(f"{path}: version {meta['version']} is there") from e
        raise


def _open(schema: T.StructType) -> dict:
    """The schema as JSON with nulls allowed everywhere, as Parquet reads them."""
    text = json.dumps(schema.jsonValue())
    for k in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{k}": false', f'"{k}": true')
    return json.loads(text)


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the last version, or of another one; of some buckets only."""
    meta = head(spark, path, version)
    if meta is None:
        raise FileNotFoundError(f"no table in {path}")
    schema = T.StructType.fromJson(meta["schema"])
    folders = [f"{path}/data/{d}/bucket={b}" for b, d in meta["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _tasks(spark: SparkSession, buckets: int) -> int:
    return min(buckets, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _store(df: DataFrame, path: str, key: list[str], buckets: int) -> dict[str, str]:
    """Write df by buckets, each from one task: bucket -> data folder."""
    own = uuid.uuid4().hex
    df.withColumn("bucket", bucket_of(key, buckets)).repartition(_tasks(df.sparkSession, buckets), "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{own}")
    return {n.split("=")[1]: own for n in names(df.sparkSession, f"{path}/data/{own}") if n.startswith("bucket=")}


def replace(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS, extra: dict | None = None) -> DataFrame:
    """df becomes the table. Returns it as it is read back."""
    spark = df.sparkSession
    have = versions(spark, path)
    folders = _store(df, path, key, buckets)
    commit(spark, path, {"version": have[-1] + 1 if have else 1, "schema": _open(df.schema), "key": key, "buckets": buckets, "folders": folders, "extra": extra or {}})
    return read(spark, path)


def upsert(new: DataFrame, path: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, extra: dict | None = None) -> DataFrame:
    """Put rows in place of those of the same key, or what merge(old rows of their buckets, new rows) makes of both. new has one
    row a key. Returns the table as it is read back. extra: kept in the version's file."""
    spark = new.sparkSession
    stage = f"{path}/stage-{uuid.uuid4().hex}"
    meta = head(spark, path)
    if meta is not None:
        key, buckets = meta["key"], meta["buckets"]
    new.withColumn("bucket", bucket_of(key, buckets)).repartition(_tasks(spark, buckets), "bucket").write.partitionBy("bucket").parquet(stage)  # computed once, whatever is done again
    try:
        touched = sorted(int(n.split("=")[1]) for n in names(spark, stage) if n.startswith("bucket="))
        for last in range(TRIES):
            meta = head(spark, path) or {"version": 0, "schema": _open(new.schema), "key": key, "buckets": buckets, "folders": {}, "extra": {}}
            schema = T.StructType.fromJson(meta["schema"])
            rows = spark.read.schema(T.StructType(list(new.schema.fields))).parquet(*[f"{stage}/bucket={b}" for b in touched]) if touched else new.limit(0)
            old = read(spark, path, buckets=touched) if meta["version"] else spark.createDataFrame([], schema)
            made = merge(old, rows) if merge else old.join(rows.select(*key), key, "left_anti").unionByName(rows)
            folders = {b: d for b, d in meta["folders"].items() if int(b) not in touched}
            if touched:
                folders |= _store(made.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]), path, key, buckets)
            try:
                commit(spark, path, meta | {"version": meta["version"] + 1, "folders": folders, "extra": meta["extra"] | (extra or {})})
                break
            except Taken:
                if last == TRIES - 1:
                    raise
    finally:
        delete(spark, stage)
    return read(spark, path)


def lookup(asked: DataFrame, path: str, few: int = FEW_KEYS) -> DataFrame:
    """The table's rows of the keys asked for. Only buckets that hold one are read; up to `few` keys (counted) are broadcast, so that
    no row that isn't asked for is shuffled; more are joined."""
    spark = asked.sparkSession
    meta = head(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no table in {path}")
    keys = asked.select(*meta["key"]).dropna().distinct()
    touched = [r.b for r in keys.select(bucket_of(meta["key"], meta["buckets"]).alias("b")).distinct().collect()]  # at most all buckets
    rows = read(spark, path, meta["version"], touched)
    return rows.join(F.broadcast(keys) if keys.limit(few + 1).count() <= few else keys, meta["key"], "left_semi")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the data folders that none of the last `keep` versions names, and older version files. Not while others write."""
    have = versions(spark, path)
    named = {d for v in have[-keep:] for d in head(spark, path, v)["folders"].values()}
    gone = [d for d in names(spark, f"{path}/data") if d not in named]
    for d in gone:
        delete(spark, f"{path}/data/{d}")
    for v in have[:-keep]:
        delete(spark, f"{path}/versions/{NAME.format(v)}")
    return len(gone)
