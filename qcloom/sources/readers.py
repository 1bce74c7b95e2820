"""Sources. Every reader is lazy but for the existence test of load_run_frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import extract as X
from ..operators import worklist as W
from ..operators.state import MANIFEST, STATE

# What a label file reads as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def settle(spark: SparkSession, path: str) -> None:
    """Finish what a writer left that broke off while it put new files in the place of old ones: with `path` away, the new ones
    if they are whole, else the old ones are put there. Old ones that are still there beside `path` go."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    now = P(path)
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.globStatus(P(f"{path}.*.old")) or ():
        old = s.getPath()
        new = P(old.toString()[: -len("old")] + "new")
        if not fs.exists(now):
            fs.rename(new if fs.exists(P(new, "_SUCCESS")) else old, now)
        if fs.exists(old):
            fs.delete(old, True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of the sinks, all strings, an empty cell as the empty string."""
    settle(spark, path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where its files have fewer splits than there are cores; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _strings(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """A CSV as all strings with stripped, lower-cased names, and each row's file by the name given."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.strip().lower() for c in df.columns]
    return df.select("*", F.col("_metadata.file_path")).toDF(*names, file) if file else df.toDF(*names)


def read_worklist(spark: SparkSession, path: str, default_type: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(items, rejects, id column) of a work-list file, or of a folder of them, in the order of their names. A column named id is
    taken as given."""
    rows = _strings(spark, path, "_file").withColumn("line_no", F.monotonically_increasing_id())
    names = [c for c in rows.columns if c not in ("line_no", "_file")]
    if len(rows.inputFiles()) > 1:
        # Spark packs files by size: rows of a file are in order, files aren't. A row a file is broadcast.
        order = rows.select("_file").distinct().withColumn("_k", F.row_number().over(Window.partitionBy().orderBy("_file")).cast("long"))
        place = F.shiftleft("_k", 33).bitwiseOR(F.col("line_no").bitwiseAND(F.lit((1 << 33) - 1)))
        rows = rows.join(F.broadcast(order), "_file").withColumn("line_no", place)
    rows = rows.select(*names, "line_no")
    col = W.detect_id_column(rows, names)
    if col is None:
        raise ValueError(f"no column of {names} holds ids")
    label = next((c for c in ("label", "name") if c in names and c != col), None)
    items, rejects = W.items_from_rows(rows, col, "type" if "type" in names else None, label, default_type or "channel", trust_raw=col == "id")
    return items, rejects, col


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, whichever way its lines end."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text"))
    return W.read_lines(whole)


def read_extracts(spark: SparkSession, path: str, schema: str = X.PLAYER) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable): saved payloads as JSON lines; unreadable ones are to be extracted again."""
    raw = spark.read.text(path).select(F.col("value").alias("payload"), F.input_file_name().alias("path"))
    d = raw.withColumn("ok_json", F.try_parse_json("payload").isNotNull())
    return d.where("ok_json").select("path", F.from_json("payload", schema).alias("p")).select("path", "p.*"), d.where("not ok_json").select("path", "payload")


def read_state_log(spark: SparkSession, path: str) -> DataFrame:
    """State rows of JSON lines, in one file or below run_id=<run>/; broken lines and those without item or stage are skipped."""
    df = spark.read.schema(STATE).option("mode", "DROPMALFORMED").json(path)
    return df.select(*T.StructType.fromDDL(STATE).names).where("item_id is not null and stage is not null")


def read_manifests(spark: SparkSession, root: str, run_ids: list[str] | None = None) -> DataFrame:
    """Manifests of all runs under root, or of some, whose files alone are opened; the folder names the run. Unreadable ones are
    ignored, as are runs without one."""
    if run_ids is None:
        paths = [f"{root}/*/manifest.json"]
    else:
        paths = [f"{root}/{r}/manifest.json" for r in dict.fromkeys(run_ids)]
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], MANIFEST)
    df = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths).select("*", F.col("_metadata.file_path").alias("_path"))
    return df.where("fingerprint is not null").withColumn("run_id", F.url_decode(F.replace(F.regexp_extract("_path", r"([^/]+)/manifest\.json(?:/[^/]+)?$", 1), F.lit("+"), F.lit("%2B")))).drop("_path")


def load_run_frame(spark: SparkSession, run_dir: str) -> tuple[DataFrame, str] | tuple[None, None]:
    """(results, schema) of a run: the wide file before the twelve-column one."""
    for name, schema in (("results", "wide"), ("qc_output", "qc")):
        for path in (f"{run_dir}/{name}", f"{run_dir}/{name}.csv"):
            settle(spark, path)
            if exists(spark, path):
                return read_csv(spark, path), schema
    return None, None


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Gold or predicted labels: all strings, the usual words for missing as null."""
    df = _strings(spark, path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_page_payloads(spark: SparkSession, path: str, kind: str, key: str = "id") -> DataFrame:
    """Captured pages as JSON lines {id, value}: key and the payload's fields."""
    schema = {"player": X.PLAYER, "about": X.ABOUT, "videos": X.GRID, "shorts": X.GRID, "tabs": X.TABS, "comments": X.COMMENTS, "transcript": X.SEGMENTS}[kind]
    raw = spark.read.schema(T.StructType().add(key, "string").add("value", "string")).json(path)
    return raw.select(key, F.from_json("value", schema).alias("p")).select(key, "p.*")
