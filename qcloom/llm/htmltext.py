"""Main text of web pages by nearest-URL page differencing.

A page becomes its text lines, one per block. What its markup declares to be no article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) is left out; lines in a declared article are marked.
Then pages of a host are sorted by URL path, each is paired with the neighbour whose path has the longer common prefix,
their lines are aligned by a longest common subsequence, and lines that both share are template and are deleted.

Sharing with one page isn't enough everywhere, so that shared lines are counted too: a line that is shared on three pages
of a host or more, and on half of its pages, has support. Where the two nearest pages differ from the page in most of their
text, a shared line outside a declared article is template as it is; with a near copy next to it, it is one only with
support. In a declared article a shared line is template only with support, and only if most of the article isn't shared
(quoted passages and copied articles do occur). Where there is a declared article nothing outside it is text: what differs
from page to page, as comments and adverts do, no difference can find.

Pages are dealt out by range of (host, path), so that a large host is many tasks; the rows at the edges of those
tasks, one each, are what neighbours across them are found with. Only line hashes and lengths are sorted, never text,
and deletions come back as line numbers by page digest.

Defined cases: null html is empty text; a null url, or one without `://`, is a page of the host `` with path ``; equal
pages are one page; a page alone on its host keeps all that isn't declared as no article; very long pages are read whole;
broken markup is read as browsers do it roughly (open tags end with their parents); an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import cut, shuffle_parts, small_batches
from .urlfilter import split_url

BROADCAST_ROWS = 100_000  # deletions of so many pages at most are broadcast (some MB); more are joined by shuffle
COPY = 0.6  # a neighbour that shares more of the text than this is a near copy
SUPPORT, MAJORITY = 3, 0.5  # pages on which a line is shared, and their share of the host's pages, that make it template

# Element names and words in class, id and role that say what a part of a page is.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math canvas object select audio video noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = set("nav footer aside form menu dialog button datalist search head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe"
    " subscription signup login sidebar navbar nav navigation menu breadcrumb breadcrumbs footer masthead comment comments respond replies disqus discussion share sharing social related"
    " recommended recommendations pagination pager skip skiplink toolbar banner alert widget widgets".split()
)
HEADERS = {"header", "masthead", "banner"}
BODIES = {"articlebody", "article-body", "post-content", "entry-content", "article-content", "post-body", "story-body", "main-content"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][-\w:]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
ARTICLE, OPEN = 1, 0


def _says(tag: str, raw: str, inside: bool) -> tuple[bool, bool]:
    """Whether this start tag opens a part that is no article, and whether it opens an article."""
    no, yes = tag in NEVER or (tag == "header" and not inside), tag in ("article", "main")
    if raw and not raw.isspace():
        for m in _ATTR.finditer(raw):
            name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").strip().lower()
            if name in ("class", "id"):
                yes = yes or any(w in BODIES for w in value.split())
                for w in re.split(r"[\s_\-]+", value):
                    if w in WORDS and not (inside and w in HEADERS):
                        no = no or tag not in ("html", "body", "main")
            elif name == "role":
                yes = yes or value in ("main", "article")
                no = no or value in ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                no = True
            elif name == "itemprop":
                yes = yes or value == "articlebody"
    return no, yes and not no


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """Text lines of a page that aren't declared as no article, in page order; ARTICLE or OPEN for each."""
    page = page or ""
    lines: list[str] = []
    marks: list[int] = []
    stack: list[tuple[str, bool, bool]] = []  # name, no article, article
    no = yes = at = 0
    part: list[str] = []

    def end_block() -> None:
        if part:
            if s := " ".join("".join(part).split()):
                lines.append(s)
                marks.append(ARTICLE if yes else OPEN)
            part.clear()

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not no:
            part.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            part.append(" ")
        if m[1]:
            if any(s[0] == tag for s in stack):
                while True:
                    name, was_no, was_yes = stack.pop()
                    if (was_no or was_yes) and name not in BLOCK:
                        end_block()
                    no -= was_no
                    yes -= was_yes
                    if name == tag:
                        break
        elif tag in RAW:
            e = _ENDS[tag].search(page, at)
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = e.end() if e else n
        elif tag not in VOID:
            is_no, is_yes = _says(tag, m[3], yes > 0)
            if is_no or is_yes:
                end_block()
            stack.append((tag, is_no, is_yes))
            no += is_no
            yes += is_yes
    end_block()
    return lines, marks


def digest(url: str | None, page: str | None) -> bytes:
    return hashlib.blake2b(f"{len(url or '')}:{url or ''}{page or ''}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _summaries(batches):
    """host, path, digest; for each line its hash, its length and its mark."""
    for b in batches:
        host, path, url, page = (b.column(k) for k in range(4))
        key, hashes, sizes, marks = [], [], [], []
        for i in range(b.num_rows):
            u, p = url[i].as_py(), page[i].as_py()
            ls, ms = lines_of(p)
            key.append(digest(u, p))
            hashes.append(b"".join(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest() for s in ls))
            sizes.append(np.array([len(s) for s in ls], np.int32).tobytes())
            marks.append(bytes(ms))
        yield pa.RecordBatch.from_arrays([host, path, *(pa.array(x, pa.binary()) for x in (key, hashes, sizes, marks))], names=["host", "path", "key", "lines", "sizes", "marks"])


def common_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    lo, na, nb = 0, len(a), len(b)
    while lo < min(na, nb) and a[lo] == b[lo]:
        lo += 1
    while na > lo and nb > lo and a[na - 1] == b[nb - 1]:
        na, nb = na - 1, nb - 1
    places: dict = {}
    for j in range(nb - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least last place in b of a common subsequence of each length
    links: list = []
    for i in range(lo, na):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    middle, x = [], links[-1] if links else None
    while x:
        middle.append(x[0])
        x = x[1]
    return [*range(lo), *reversed(middle), *range(na, len(a))]


class Row:
    def __init__(self, host, path, key, lines, sizes, marks) -> None:
        self.host, self.path, self.key = host, path, key
        self.lines = np.frombuffer(lines, np.int64).tolist()
        self.sizes, self.marks = np.frombuffer(sizes, np.int32), np.frombuffer(marks, np.uint8)

    def shared(self, other: Row) -> list[int]:
        return common_lines(self.lines, other.lines) if not set(self.lines).isdisjoint(other.lines) else []

    def part(self, got: list[int], mark: int | None = None) -> float:
        """The share of this page's text, or of that with a mark, which these lines are."""
        size = self.sizes if mark is None else self.sizes * (self.marks == mark)
        return float(size[got].sum() / max(size.sum(), 1))


def _near(a: Row, b: Row | None) -> int:
    if b is None or b.host != a.host:
        return -1
    k = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        k += 1
    return k


def _rows(batches):
    for b in batches:
        yield from (Row(*x) for x in zip(*(c.to_pylist() for c in b.columns)))


def _edges(batches):
    """The first and the last row of a task."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first = first if first is not None else b.slice(0, 1)
            last = b.slice(b.num_rows - 1, 1)
    if first is not None:
        k = pa.array([TaskContext.get().partitionId()], pa.int32())
        for which, x in ((0, first), (1, last)):
            yield pa.RecordBatch.from_arrays([k, pa.array([which], pa.int32()), *x.columns], names=["task", "last", *x.schema.names])


def _differences(edges):
    """Host and digest of each page, and its lines that may be template: number, hash, and whether the difference is
    enough to say so."""

    def run(batches):
        task, ends = TaskContext.get().partitionId(), edges.value
        before = max((t for t, last in ends if last and t < task), default=None)
        after = min((t for t, last in ends if not last and t > task), default=None)
        prev = Row(*ends[before, 1]) if before is not None else None
        here, out = None, []

        def settle(next_) -> None:
            near = sorted((x for x in (prev, next_) if x is not None and x.host == here.host), key=lambda x: -_near(here, x))
            tried = [here.shared(x) for x in near]
            got = next((g for g in tried if here.part(g) <= COPY), None)
            copy = got is None
            got = (tried[0] if tried else []) if copy else got
            whole = here.part(got, ARTICLE) > COPY
            found = [(k, here.lines[k], here.marks[k] == OPEN and not copy) for k in got if here.marks[k] == OPEN or not whole]
            if found:
                out.append((here.host, here.key, *zip(*found)))

        for row in _rows(batches):
            if here is not None:
                settle(row)
                prev = here
            here = row
        if here is not None:
            settle(Row(*ends[after, 0]) if after is not None else None)
        kinds = (pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array([list(r[k]) if k > 1 else r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["host", "key", "place", "line", "sure"])

    return run


def template_lines(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, gone): for pages that have any, the numbers of their lines that are template."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    src = pages.select(host.alias("host"), path.alias("path"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    rows = src.mapInArrow(_summaries, "host string, path string, key binary, lines binary, sizes binary, marks binary").dropDuplicates(["key"])
    names = ["host", "path", "key"]
    line = cut(rows.repartitionByRange(shuffle_parts(spark), *names).sortWithinPartitions(*names))
    ends = line.mapInArrow(_edges, "task int, last int, host string, path string, key binary, lines binary, sizes binary, marks binary").collect()  # two rows a task
    shared = spark.sparkContext.broadcast({(r.task, r.last): tuple(r)[2:] for r in ends})
    kind = "host string, key binary, place array<int>, line array<bigint>, sure array<boolean>"
    found = cut(line.mapInArrow(_differences(shared), kind)).select("host", "key", F.explode(F.arrays_zip("place", "line", "sure")).alias("x")).select("host", "key", "x.*")
    many = found.groupBy("host", "line").agg(F.count_distinct("key").alias("on")).where(F.col("on") >= SUPPORT)
    many = cut(many.join(line.groupBy("host").agg(F.count("*").alias("pages")), "host").where(F.col("on") >= MAJORITY * F.col("pages")).select("host", "line", F.lit(True).alias("much")))
    few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = found.join(F.broadcast(many) if few else many, ["host", "line"], "left").where(F.col("sure") | F.coalesce("much", F.lit(False)))
    return both.groupBy("key").agg(F.collect_set("place").alias("gone"))  # no more of them than a page has lines


def _texts(batches):
    for b in batches:
        out = []
        url, page, gone = (b.column(b.schema.get_field_index(c)) for c in ("url", "h", "gone"))
        for i in range(b.num_rows):
            ls, ms = lines_of(page[i].as_py())
            g, declared = set(gone[i].as_py() or ()), ARTICLE in ms
            out.append("\n".join(s for k, (s, m) in enumerate(zip(ls, ms)) if k not in g and (m == ARTICLE or not declared)))
        yield pa.RecordBatch.from_arrays([b.column(0), url, pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _with_key(batches):
    for b in batches:
        key = [digest(u, h) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.binary())], names=["page_id", "url", "h", "key"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    gone = cut(template_lines(pages, url_col, html_col))
    kind = pages.schema[id_col].dataType.simpleString()
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"))
    keyed = p.mapInArrow(_with_key, f"page_id {kind}, url string, h string, key binary")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = keyed.join(F.broadcast(gone) if few else gone, "key", "left").select("page_id", "url", "h", "gone")
    got = both.mapInArrow(_texts, f"page_id {kind}, url string, text string")
    return got.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
