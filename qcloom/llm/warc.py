"""WARC archives: pages are written as records, long records in segments; archives are read back and segments put together.

Writing. Each page is an HTTP response with chunked transfer framing. Of pages with equal payloads one is a `response`,
that of the largest id; the others are `revisit` records without payload that refer to it. Blocks of more than
`segment_bytes` become a first segment and `continuation` records. Spark's text writer makes the files: the
separator of its lines is what ends a WARC record, so that writing needs no file handles and survives lost executors.

Reading. Spark's text reader splits archives at the version line that begins a record, so that a file of any size is a
stream of records. A piece shorter than its Content-Length was split at a version line inside a payload and is put
together with what follows it. Continuations are grouped by the origin's identifier and ordered by number; numbers must run
from 1 on without a gap and the lengths must sum to the total that the last one states. Then chunked framing is
decoded and the payload's digest is compared. Nothing is dropped: a record that fails says why in `problem`.

Hot payloads: pages are reduced to digests, counted by digest, id and url first, so that copies combine before the shuffle;
the digests that repeat are broadcast up to BROADCAST of them, else joined, where AQE splits a hot one.

Defined cases: null html is an empty payload; a null id has no header and is the smallest; a null url is none; of rows that
repeat payload, id and url exactly one is a response; white space and control characters of urls are percent-encoded in
headers; an empty table writes no records; other columns, whatever their names, are ignored. Two records with one
identifier and number, of equal content, are one; of other content they are a problem.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import scratch, small_batches, written

VERSION = "WARC/1.1"
SEGMENT_BYTES = 1 << 14  # rows between tasks stay small, and a damaged file costs little
CHUNK_BYTES = 1 << 13
BROADCAST = 200_000  # digests that repeat, some 150 bytes each, that are broadcast; more of them are joined
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "headers map<string,string>, block binary, problem string"

# --------------------------------------------------------------------------- bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk ends inside every version line, so that none is left in the block."""
    cuts = sorted({*range(0, len(data), size), *(m.start() + 4 for m in re.finditer(re.escape(VERSION.encode()), data)), len(data)})
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        parts += [b"%x\r\n" % (b - a), data[a:b], b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes | None:
    """What chunked framing holds, without extensions and trailers; None if the framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size := data[at:end].split(b";")[0].strip()):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out) if data.startswith(b"\r\n", at) or data.find(b"\r\n\r\n", at) >= 0 else None
        if data[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(data[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line ends behind it."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parsed(piece: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(headers by lower-case name, what lies behind them, Content-Length) of a record without its version line."""
    head, mark, rest = piece.partition(b"\r\n\r\n")
    if not mark:
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
    n = headers.get("content-length", "")
    return (headers, rest, int(n)) if re.fullmatch(r"\d+", n) else None


def payload(headers: dict[str, str], block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a whole record: of HTTP responses the body, unframed; revisits have none."""
    if headers.get("warc-type") == "revisit":
        return None, None
    if headers.get("content-type", "").startswith("application/http"):
        head, mark, body = block.partition(b"\r\n\r\n")
        if not mark:
            return None, "no HTTP header"
        if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head):
            body = dechunked(body)
            if body is None:
                return None, "broken chunks"
    else:
        body = block
    told = headers.get("warc-payload-digest", "")
    if told.startswith("sha1:") and told[5:] != base32_sha1(body):
        return body, "other digest"
    return body, None


def _uri(url: str | None) -> str | None:
    if url is None:
        return None
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url).replace(VERSION, VERSION.replace("/", "%2F"))


def _named(sha: bytes) -> str:
    """The identifier of the response that holds a payload: there is one for each."""
    return f"<urn:uuid:{uuid.UUID(bytes=sha[:16])}>"


# --------------------------------------------------------------------------- writing


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, payload, sha, record_type, refers_to, refers_url): one row per page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    same = rows.groupBy("sha", "page_id", "url").agg(F.count("*").alias("c"))
    heads = same.groupBy("sha").agg(F.max(F.struct("page_id", "url", "c")).alias("head"), F.sum("c").alias("n")).where("n > 1")
    heads = written(heads.select(F.col("sha").alias("_sha"), "head"))
    few = heads.count() <= broadcast
    joined = rows.join(F.broadcast(heads) if few else heads, F.col("sha") == F.col("_sha"), "left")
    is_head = F.col("_sha").isNull() | (F.col("page_id").eqNullSafe(F.col("head.page_id")) & F.col("url").eqNullSafe(F.col("head.url")))

    def out(df: DataFrame, response: Column) -> DataFrame:
        old = F.when(~response, F.col("head"))
        return df.select("page_id", "url", "payload", "sha", F.when(response, "response").otherwise("revisit").alias("record_type"), old["page_id"].alias("refers_to"), old["url"].alias("refers_url"))

    if heads.where("head.c > 1").isEmpty():
        return out(joined, is_head)
    # rows that are equal in all: brought together as one row and a number, the first of which is the response
    again = F.coalesce(F.col("head.c") > 1, F.lit(False)) & is_head
    one = joined.where(again).groupBy("sha").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "_sha", "head")], F.count("*").alias("c"))
    return out(joined.where(~again), is_head).unionByName(out(one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))), F.col("i") == 1))


def records(roles: DataFrame, segment_bytes: int = SEGMENT_BYTES, date: str | None = None) -> DataFrame:
    """(value): the bytes of every record of with_roles' rows, long ones as several."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def framed(row) -> list[bytes]:
        ident = _named(row["sha"])
        head = [("WARC-Date", date), ("WARC-Target-URI", _uri(row["url"])), ("WARC-Payload-Digest", f"sha1:{base32_sha1(row['payload'])}"), ("Payload-Length", str(len(row["payload"]))), ("Page-ID", row["id"])]
        if row["record_type"] == "revisit":
            head = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *head, ("WARC-Profile", REVISIT), ("WARC-Refers-To", ident), ("WARC-Refers-To-Target-URI", _uri(row["refers_url"])), ("Refers-To-Page-ID", row["refers"])]
            return [record(head, b"")]
        block = HTTP + chunked(row["payload"])
        head = [("WARC-Type", "response"), ("WARC-Record-ID", ident), *head, ("Content-Type", "application/http; msgtype=response")]
        if len(block) <= segment_bytes:
            return [record(head, block)]
        parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
        out = [record([*head, ("WARC-Segment-Number", "1")], parts[0])]
        for k, part in enumerate(parts[1:], 2):
            own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(row['sha'] + b'%d' % k).digest()[:16])}>"
            last = str(len(block)) if k == len(parts) else None
            out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", last)], part))
        return out

    def write(batches):
        waiting, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for r in framed({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}):
                    waiting.append(r)
                    size += len(r)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], names=["value"])
                        waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], names=["value"])

    small_batches(roles.sparkSession)
    ids = [F.col("page_id").cast("string").alias("id"), F.col("refers_to").cast("string").alias("refers")]
    return roles.select("url", "payload", "sha", "record_type", "refers_url", *ids).mapInArrow(write, "value binary")


def write_warc(recs: DataFrame, path: str, compression: str = "gzip") -> None:
    """A folder of archives, one a task."""
    recs.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


# --------------------------------------------------------------------------- reading


def read_warc(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """(headers by lower-case name, block, problem): every record of the archives. Uncompressed files are split; where a payload
    holds a version line at such a split, the record is a problem rather than wrong."""
    mark = f"{version}\r\n".encode()

    def done(got, problem=None):
        return (got[0], got[1][: got[2]], problem) if got else ({}, b"", "no WARC header")

    def records_of(pieces):
        """Pieces are (file, bytes) in order; one that is too short goes on in the next of its file."""
        held, name = None, None
        for file, piece in pieces:
            if held is not None and file == name:
                held = (held[0], held[1] + mark + piece, held[2])
            else:
                if held is not None:
                    yield done(held, "shorter than its Content-Length")
                if not piece:
                    held = None
                    continue
                held, name = parsed(piece), file
                if held is None:
                    yield done(None)
                    continue
            if len(held[1]) >= held[2]:
                yield done(held, None if not held[1][held[2] :].strip(b"\r\n") else "longer than its Content-Length")
                held = None
        if held is not None:
            yield done(held, "shorter than its Content-Length")

    def read(batches):
        def pieces():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

        kind = pa.map_(pa.string(), pa.string())
        rows, size = [], 0
        for r in records_of(pieces()):
            rows.append(r)
            size += len(r[1])
            if size > 1 << 22 or len(rows) == 1000:
                yield batch_of(rows, kind)
                rows, size = [], 0
        if rows:
            yield batch_of(rows, kind)

    def batch_of(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([list(r[0].items()) for r in rows], kind), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["headers", "block", "problem"])

    small_batches(spark)
    text = spark.read.option("lineSep", mark.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(read, RECORD)


def reassembled(recs: DataFrame) -> DataFrame:
    """(headers, parts, problem): segmented records put together by origin, others as they are. parts are the blocks in order."""
    h = F.col("headers")
    number = h["warc-segment-number"]
    whole = recs.where(number.isNull()).select("headers", F.array("block").alias("parts"), "problem")
    seg = recs.where(number.isNotNull()).select(
        F.coalesce(h["warc-segment-origin-id"], h["warc-record-id"]).alias("origin"), F.try_to_number(number, F.lit("9999999999")).cast("long").alias("k"),
        F.try_to_number(h["warc-segment-total-length"], F.lit("999999999999999999")).cast("long").alias("total"), "headers", "block", "problem",
    )
    g = seg.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("k", "total", "block"))).alias("s"), F.first(F.when(F.col("k") == 1, F.col("headers")), True).alias("headers"), F.first("problem", True).alias("problem"),
    )
    sizes = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    runs = F.transform("s", lambda x: x["k"]) == F.sequence(F.lit(1).cast("long"), F.size("s").cast("long"))
    total = F.element_at("s", -1)["total"]
    why = F.coalesce(
        F.col("problem"), F.when(F.col("headers").isNull(), "no first segment"), F.when(~F.coalesce(runs, F.lit(False)), "segments missing or repeated"),
        F.when(total.isNull(), "no last segment"), F.when(total != sizes, "other total length"),
    )
    return whole.unionByName(g.select(F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), F.transform("s", lambda x: x["block"]).alias("parts"), why.alias("problem")))


def payloads(logical: DataFrame) -> DataFrame:
    """(headers, payload, payload_bytes, payload_digest, problem) of whole records. Revisits have no payload: their length and digest are
    those that their headers state."""

    def decode(batches):
        for batch in batches:
            out = []
            heads, parts, why = (batch.column(k) for k in range(3))
            for i in range(batch.num_rows):
                headers, problem = dict(heads[i].as_py()), why[i].as_py()
                body = None
                if problem is None:
                    body, problem = payload(headers, b"".join(parts[i].as_py()))
                n, told = headers.get("payload-length"), headers.get("warc-payload-digest", "")
                if body is not None:
                    out.append((headers, body, len(body), base32_sha1(body), problem))
                else:
                    out.append((headers, None, int(n) if n and n.isdigit() else None, told.removeprefix("sha1:") or None, problem))
            kinds = (pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([list(r[0].items()) if not k else r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["headers", "payload", "payload_bytes", "payload_digest", "problem"])

    return logical.mapInArrow(decode, "headers map<string,string>, payload binary, payload_bytes long, payload_digest string, problem string")


def read_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, problem): one row per record of a page."""
    h = F.col("headers")
    kind = F.coalesce(h["warc-type"], F.lit(""))
    return payloads(reassembled(read_warc(spark, path)).where(kind != "warcinfo")).select(
        h["page-id"].cast(id_type).alias("page_id"), h["warc-target-uri"].alias("url"), h["warc-type"].alias("record_type"), h["refers-to-page-id"].cast(id_type).alias("refers_to"),
        "payload", "payload_bytes", "payload_digest", "problem",
    )


def archived(pages: DataFrame, path: str, **how) -> DataFrame:
    """Write pages to `path` and read them back; a record that doesn't come back whole is an error."""
    write_warc(records(with_roles(pages), **how), path)
    back = read_pages(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("archive: "), F.col("problem"))))
    return back.withColumn("record_type", sound)


def query(spark, sf_dir: str) -> DataFrame:
    scratch(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    return archived(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 in SQL: each 5 hex digits of the SHA-1 are 4 of its 32 letters.
SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
r AS (
  SELECT *, first_value(page_id) OVER w AS head, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(s, (i // 4)::BIGINT * 5 + 1, 5))::BIGINT >> ((3 - i % 4) * 5)) & 31)::BIGINT + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN head END AS refers_to FROM r
"""
