"""Work lists: messy text and spreadsheet rows to typed, deduplicated ids.

Row order is explicit: `line_no` of the line and `pos` inside it. Items have id, type, label, line_no, pos, seen.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import blank_cell, let, norm, or_null, strip, text
from ..functions.vocab import HEADER_WORDS, ID_HEADERS

# Shapes of ids.
CHANNEL = "UC[0-9A-Za-z_-]{22}"
VIDEO = "[0-9A-Za-z_-]{11}"
HANDLE = r"@[A-Za-z0-9_.\-]{3,30}"
CHANNEL_URL = rf"(?i)youtube\.com/channel/({CHANNEL})"
HANDLE_URL = rf"(?i)youtube\.com/({HANDLE})"
VIDEO_URLS = [rf"[?&]v=({VIDEO})", rf"(?i)youtu\.be/({VIDEO})", rf"(?i)youtube\.com/shorts/({VIDEO})"]

FOUND = "array<struct<id:string,forced:string>>"


def norm_type(c: Column) -> Column:
    t = norm(c)
    return F.when(t.isin("channel", "channels", "chan", "ch"), F.lit("channel")).when(t.isin("video", "videos", "vid"), F.lit("video"))


def _id(value: Column, forced: str | None) -> Column:
    return F.struct(value.alias("id"), F.lit(forced).cast("string").alias("forced"))


def token_id(token: Column) -> Column:
    """(id, forced) of one token, or null. URLs come first, then a bare channel id, a handle, and 11 characters."""

    def first(t: Column) -> Column:
        urls = [(CHANNEL_URL, "channel"), *((p, "video") for p in VIDEO_URLS), (HANDLE_URL, "channel")]
        bare = [(f"^({CHANNEL})$", "channel"), (f"^({HANDLE})$", "channel"), (f"^({VIDEO})$", None)]
        ids = lambda ps: F.array(*[_id(F.regexp_extract(t, p, 1), forced) for p, forced in ps])
        url = F.lower(t).contains("youtu") | t.contains("v=")
        all_ = F.when(url, ids(urls + bare)).otherwise(ids(bare))
        return F.get(F.filter(all_, lambda x: x["id"] != ""), F.lit(0))

    return let(F.regexp_replace(strip(token), "^,+|,+$", ""), first)


def split_csv_line(line: Column) -> Column:
    """(id, forced, line_type, label) of an `id,type,label` line; null for anything else. The label may hold commas."""

    def whole(p: Column) -> Column:
        part = lambda k: F.get(p, F.lit(k))
        fields = F.struct(token_id(part(0)).alias("hit"), text(part(1)).alias("second"), norm_type(part(1)).alias("kind"), or_null(strip(part(2))).alias("label"))
        fits = lambda x: x["hit"].isNotNull() & ((x["second"] == "") | x["kind"].isNotNull())
        return let(fields, lambda x: F.when(fits(x), F.struct(x["hit"]["id"].alias("id"), x["hit"]["forced"].alias("forced"), x["kind"].alias("line_type"), x["label"].alias("label"))))

    return let(F.split(line, ",", 3), whole)


def extract_freeform(line: Column) -> Column:
    """All ids of a line, in order of kind: channel ids, video urls, handles, bare words of 11 characters."""
    kinds = [(CHANNEL, "channel", 0), *((p, "video", 1) for p in VIDEO_URLS), (HANDLE, "channel", 0)]

    def take(rest: Column, k: int) -> Column:
        if k == len(kinds):
            return words(rest)
        pattern, forced, group = kinds[k]
        found = F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(group)), lambda x: _id(x, forced))
        return F.concat(found, let(F.regexp_replace(rest, pattern, " "), lambda r: take(r, k + 1)))

    def words(rest: Column) -> Column:
        return F.transform(F.regexp_extract_all(rest, F.lit(rf"(?U)(?<!\S){VIDEO}(?!\S)"), F.lit(0)), lambda w: _id(w, None))

    marked = lambda r: r.contains("UC") | r.contains("@") | r.contains("v=") | F.lower(r).contains("youtu")
    return let(line, lambda r: F.when(marked(r), take(r, 0)).otherwise(words(r)))


def resolve_type(id_: Column, forced: Column, line_type: Column, default_type: str | None) -> Column:
    shape = F.when(id_.startswith("@") | id_.rlike(f"^{CHANNEL}$"), F.lit("channel"))
    return F.coalesce(forced, shape, line_type, norm_type(F.lit(default_type).cast("string")), F.lit("video"))


def read_lines(pasted: DataFrame, col: str = "text") -> DataFrame:
    """(line_no, line) of pasted text; CRLF and CR end lines too. Further columns of the row stay."""
    rest = [c for c in pasted.columns if c != col]
    return pasted.select(*rest, F.posexplode(F.split(F.regexp_replace(col, "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def skip_header(lines: DataFrame) -> DataFrame:
    """Without blank lines, and without lines of header words only."""
    fields = F.transform(F.split("line", ","), norm)
    header = F.forall(fields, lambda x: x.isin(*HEADER_WORDS))
    return lines.withColumn("line", strip(F.col("line"))).where((F.col("line") != "") & ~header)


def line_ids(lines: DataFrame) -> DataFrame:
    """found: array of (id, forced, line_type, label) of each line."""
    null = F.lit(None).cast("string")
    free = lambda line: F.transform(extract_freeform(line), lambda x: F.struct(x["id"].alias("id"), x["forced"].alias("forced"), null.alias("line_type"), null.alias("label")))
    return lines.withColumn("found", let(split_csv_line(F.col("line")), lambda csv: F.when(csv.isNotNull(), F.array(csv)).otherwise(free(F.col("line")))))


def dedupe_first_seen(found: DataFrame) -> DataFrame:
    """One row per id: type of its first sighting, its first label that isn't empty, how often it was seen."""
    at = F.struct("line_no", "pos")
    label = F.min_by("label", F.when(F.coalesce(F.col("label"), F.lit("")) != "", at))
    first = F.min(at)
    out = found.groupBy("id").agg(F.min_by("type", at).alias("type"), label.alias("label"), first.alias("at"), F.count("*").alias("seen"))
    return out.select("id", "type", "label", F.col("at.line_no").alias("line_no"), F.col("at.pos").alias("pos"), "seen")


def _typed(found: DataFrame, default_type: str | None) -> DataFrame:
    each = found.select("line_no", F.posexplode("found").alias("pos", "f"))
    return each.select("line_no", "pos", F.col("f.id").alias("id"), resolve_type(F.col("f.id"), F.col("f.forced"), F.col("f.line_type"), default_type).alias("type"), F.col("f.label").alias("label"))


def parse_items(lines: DataFrame, default_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items and rejected lines of (line_no, line) rows."""
    found = line_ids(skip_header(lines.select("line_no", "line")))
    return dedupe_first_seen(_typed(found, default_type)), found.where(F.size("found") == 0).select("line_no", "line")


def parse_report(items: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: channels, videos, deduped, unrecognized."""
    n = items.agg(
        F.count_if(F.col("type") == "channel").alias("channels"), F.count_if(F.col("type") == "video").alias("videos"),
        F.coalesce(F.sum(F.col("seen") - 1), F.lit(0)).alias("deduped"),
    )
    return n.crossJoin(rejects.agg(F.count("*").alias("unrecognized")))  # one row each


def detect_id_column(rows: DataFrame, columns: list[str] | None = None, sample: int = 200) -> str | None:
    """The column that holds ids, if any. rows may have line_no for their order."""
    columns = columns or [c for c in rows.columns if c != "line_no"]
    for c in columns:
        if c.strip().lower() == "id":
            return c
    got = id_column_scores(rows, columns, sample).orderBy(F.desc("score"), "idx").first()
    return got.column if got and got.score >= 0.5 else None


def id_column_scores(rows: DataFrame, columns: list[str], sample: int = 200) -> DataFrame:
    """(column, idx, cells, hits, score) over each column's first `sample` cells that aren't blank.

    A top-k for each column: every task keeps its own first cells before any shuffle, so no column is sorted whole.
    """
    order = F.col("line_no") if "line_no" in rows.columns else F.monotonically_increasing_id()
    cells = rows.select(order.alias("line_no"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("idx"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(columns)])).alias("x"))
    cells = cells.select("line_no", "x.*").where(~blank_cell(F.col("cell")))
    rank = F.row_number().over(Window.partitionBy("column", "idx").orderBy("line_no"))
    cells = cells.withColumn("rank", rank).where(F.col("rank") <= sample)
    s = strip(F.col("cell"))
    hit = token_id(s).isNotNull() | (F.size(extract_freeform(s)) > 0)
    by = cells.groupBy("column", "idx").agg(F.count("*").alias("cells"), F.count_if(hit).alias("hits"))
    hint = F.when(F.lower(F.trim("column")).isin(*ID_HEADERS), 0.15).otherwise(0.0)
    return by.withColumn("score", F.col("hits") / F.col("cells") + hint)


def items_from_rows(rows: DataFrame, id_col: str, type_col: str | None = None, label_col: str | None = None, default_type: str | None = None, trust_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items and rejected cells of spreadsheet rows (with line_no)."""
    none = F.lit(None).cast("string")
    raw = text(F.col(f"`{id_col}`").cast("string"))
    line_type = norm_type(F.col(f"`{type_col}`").cast("string")) if type_col else none
    label = F.when(~blank_cell(F.col(f"`{label_col}`").cast("string")), strip(F.col(f"`{label_col}`").cast("string"))) if label_col else none
    d = rows.select("line_no", raw.alias("line"), line_type.alias("line_type"), label.alias("label")).where(~blank_cell(F.col("line")))
    d = d.withColumn("one", token_id(F.col("line"))).withColumn("free", extract_freeform(F.col("line")))
    as_given = F.array(_id(F.col("line"), None)) if trust_raw else F.array().cast(FOUND)
    ids = F.when(F.col("one").isNotNull(), F.array("one")).when(F.size("free") > 0, F.col("free")).otherwise(as_given)
    found = d.withColumn("ids", ids).withColumn("found", F.transform("ids", lambda x: F.struct(x["id"].alias("id"), x["forced"].alias("forced"), F.col("line_type").alias("line_type"), F.col("label").alias("label"))))
    return dedupe_first_seen(_typed(found, default_type)), found.where(F.size("found") == 0).select("line_no", "line")


def fingerprint(items: DataFrame, *by: str) -> DataFrame:
    """16 hex digits that name a work list (one for each group of `by`), whatever its order and duplicates: SHA-1 of the sorted
    keys, a line each.

    Keys are sorted by Spark, in ranges, and stream through the digest in order, so that no list is held in one value. A
    digest has one order, so that the reading of one list is one task; its memory doesn't grow.
    """
    names = [f"by{i}" for i in range(len(by))]
    keys = items.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.concat("type", F.lit(":"), F.col("id").cast("string")).alias("key")).where("key is not null").distinct()
    if by:
        ordered = keys.repartition(*names).sortWithinPartitions(*names, "key")
    else:
        ordered = keys.orderBy("key").coalesce(1)  # sorted ranges, read one after the other

    def digest(batches):
        group, sha, n = None, None, 0
        out = []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            runs = ((g, [row[-1] for row in rows]) for g, rows in groupby(zip(*cols), key=lambda row: row[:-1])) if by else [((), cols[-1])]
            for own, lines in runs:
                if not lines:
                    continue
                if sha is None or own != group:
                    if sha is not None:
                        out.append((*group, sha.hexdigest()[:16], n))
                    group, sha, n = own, hashlib.sha1(), 0
                sha.update((("\n" if n else "") + "\n".join(lines)).encode())
                n += len(lines)
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=to_names)
                out = []
        if sha is not None:
            out.append((*group, sha.hexdigest()[:16], n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=to_names)

    schema = T.StructType([keys.schema[n] for n in names]).add("fingerprint", "string").add("total_items", "long")
    kinds, to_names = [f.type for f in to_arrow_schema(schema)], schema.names
    marks = ordered.mapInArrow(digest, schema)
    if by:
        return marks.withColumnsRenamed(dict(zip(names, by)))
    empty = hashlib.sha1(b"").hexdigest()[:16]  # an empty list has a name too
    return marks.agg(F.coalesce(F.max("fingerprint"), F.lit(empty)).alias("fingerprint"), F.coalesce(F.max("total_items"), F.lit(0)).cast("long").alias("total_items"))


def plan_estimate(items: DataFrame, lanes: int = 1, video_s: float = 16.0, channel_s: float = 50.0, *by: str) -> DataFrame:
    """channels, videos, model calls and minutes of a work list."""
    n = items.groupBy(*by).agg(F.count_if(F.col("type") == "channel").alias("channels"), F.count_if(F.col("type") == "video").alias("videos"))
    return n.withColumn("calls", 2 * F.col("videos") + 2 * F.col("channels")).withColumn("minutes", (video_s * F.col("videos") + channel_s * F.col("channels")) / 60.0 / lanes)


def limit_items(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy("line_no", "pos").limit(n)


def channel_base_url(id_: Column) -> Column:
    handle = F.when(id_.startswith("@"), id_).otherwise(F.concat(F.lit("@"), id_))
    return F.when(id_.rlike(f"^{CHANNEL}$"), F.concat(F.lit("https://www.youtube.com/channel/"), id_)).otherwise(F.concat(F.lit("https://www.youtube.com/"), handle))
