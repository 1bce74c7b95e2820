"""URL filter: hand-written rules first, then a path-template tree per host.

Rules are a short list kept in the plan. A url that no rule fits is judged by its template:

1. Per host, paths grow into a tree of segments, level by level. A segment stays as it is when it has no digit and
   its node has at most WORDS such children, or when it is frequent (8 urls and a sixteenth of the node's);
   every other one becomes the wildcard `*`. Below DEPTH levels the rest of a path is `**`.
2. Sibling templates are merged when they are statistically alike: in order of their blocked share, a branch
   joins the one before unless the shares differ by more than 1.96 standard errors.
3. Urls that a rule judged are the labels. A template's purity is its group's blocked share, smoothed towards the
   share of the same template on all hosts, and that towards the overall share. At one half or more it's rejected.

All statistics are hash aggregations over distinct (host, path) pairs with map-side combining; the tree's nodes
are joined back level by level, and nothing is gathered per host, so that a host with a third of all pages is
no hot task (a join key is host, template and segment, or a salt of it, and AQE splits what is left).

Defined cases: a null url, or one without `://`, has empty host and path and no rule, and is judged as the template
of that empty path; repeated rows get the same verdict each; an empty table gives no rows; with no labels at all the
purity is one half of nothing, smoothed to 0.5 by the prior of one allowed and one blocked url, hence `block` only
if DEFAULT says so; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import spread
from .common import cut

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
BROADCAST_BYTES = 8 << 20  # scores with so many bytes of hosts and templates at most are broadcast; more are joined by shuffle
SALTS = 8  # a node's row is repeated so many times, its children are dealt out to them
DEPTH, WORDS, OFTEN, SHARE, Z, PULL = 6, 32, 8, 16, 1.96, 2.0
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), F.regexp_extract(u, URL, 2)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits."""
    hit = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        hit.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.greatest(*hit) if len(hit) > 1 else hit[0] if hit else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return best["rule"], best["verdict"]


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, path, n, ...) rows with their template in `template`, and its parent node in `parent`."""
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = paths.withColumn("segs", segs).withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(1, min(depth, deepest) + 1):
        child = F.try_element_at("segs", F.lit(d))
        nodes = rows.where(child.isNotNull()).groupBy("host", "template", child.alias("child")).agg(F.sum("n").alias("cn"))
        word = ~F.col("child").rlike("[0-9]")
        above = nodes.groupBy("host", "template").agg(F.sum("cn").alias("pn"), F.count_if(word).alias("words"))
        fixed = (word & (F.col("words") <= WORDS)) | ((F.col("cn") >= OFTEN) & (F.col("cn") * SHARE >= F.col("pn")))
        # dealt by a salt of the child too, so that a node with many children is several tasks, each of which AQE can split
        salted = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        names = nodes.withColumn("salt", F.pmod(F.hash("child"), F.lit(SALTS))).join(salted, ["host", "template", "salt"]).select("host", "template", "child", F.when(fixed, F.col("child")).otherwise(F.lit("*")).alias("name"))
        rows = rows.withColumn("child", child).join(names, ["host", "template", "child"], "left").drop("child")
        deeper = F.col("name").isNotNull()
        rows = rows.withColumn("parent", F.when(deeper, F.col("template")).otherwise(F.col("parent"))).withColumn("template", F.when(deeper, F.concat("template", F.lit("/"), "name")).otherwise(F.col("template"))).drop("name")
    long = F.size("segs") > depth
    return rows.withColumn("parent", F.when(long, F.col("template")).otherwise(F.col("parent"))).withColumn("template", F.when(long, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("segs")


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, score): smoothed blocked share of each host's templates."""
    leaf = tree.groupBy("host", "parent", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    rate = (F.col("b") + 1.0) / (F.col("l") + 2.0)
    known = leaf.where("l > 0").withColumn("rate", rate).withColumn("var", F.col("rate") * (1.0 - F.col("rate")) / (F.col("l") + 2.0))
    line = Window.partitionBy("host", "parent").orderBy("rate", "template")  # siblings: at most WORDS + SHARE + 1 rows
    step = F.col("rate") - F.lag("rate").over(line) > Z * F.sqrt(F.col("var") + F.lag("var").over(line))
    known = known.withColumn("new", F.when(step, 1).otherwise(0)).withColumn("g", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "parent", "g")
    known = known.select("host", "template", F.sum("l").over(group).alias("gl"), F.sum("b").over(group).alias("gb"))
    total = leaf.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("l"), F.lit(0)) + 2.0)).alias("base"))  # one row
    across = leaf.groupBy("template").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
    across = across.crossJoin(F.broadcast(total)).select("template", ((F.col("tb") + PULL * F.col("base")) / (F.col("tl") + PULL)).alias("prior"))
    out = leaf.select("host", "template").join(known, ["host", "template"], "left").join(across, "template")
    return out.select("host", "template", ((F.coalesce("gb", F.lit(0)) + PULL * F.col("prior")) / (F.coalesce("gl", F.lit(0)) + PULL)).alias("score"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, reject_at: float = 0.5, depth: int = DEPTH) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, score (null where a rule decides)."""
    host, path = split_url(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("said", said)
    paths = p.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("said").alias("l"), F.count_if(F.col("said") == "block").alias("b"))
    tree = cut(templates(cut(paths), depth))
    scores = cut(purities(tree))  # cut, so that a template with many paths is a skewed join that AQE can split, not the end of an aggregation
    small = (scores.agg(F.sum(F.octet_length("host") + F.octet_length("template") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    scored = tree.select("host", "path", "template").join(F.broadcast(scores) if small else scores, ["host", "template"])
    out = p.join(scored, ["host", "path"], "left")
    by = F.when(F.col("score") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", by).alias("verdict"), "template", F.when(F.col("rule").isNull(), F.col("score")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("page_id", "host", "path", "rule", "verdict", "template")


def _sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda x: (-len(x[0]), x[0]))
        for h, _, p in [r.partition("/")]
    )
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    level = lambda d: f""",
n{d} AS (SELECT host, template, segs[{d}] AS child, sum(n) AS cn FROM t{d - 1} WHERE len(segs) >= {d} GROUP BY ALL),
a{d} AS (SELECT host, template, sum(cn) AS pn, count(*) FILTER (NOT regexp_matches(child, '[0-9]')) AS words FROM n{d} GROUP BY ALL),
m{d} AS (SELECT host, template, child, CASE WHEN (NOT regexp_matches(child, '[0-9]') AND words <= {WORDS}) OR (cn >= {OFTEN} AND cn * {SHARE} >= pn) THEN child ELSE '*' END AS name FROM n{d} JOIN a{d} USING (host, template)),
t{d} AS (SELECT t.host, path, n, l, b, segs, CASE WHEN name IS NULL THEN t.template ELSE t.template || '/' || name END AS template, CASE WHEN name IS NULL THEN parent ELSE t.template END AS parent
  FROM t{d - 1} t LEFT JOIN m{d} m ON t.host = m.host AND t.template = m.template AND len(segs) >= {d} AND segs[{d}] = m.child)"""  # noqa: E731
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
p AS (SELECT *, CASE rule {said} END AS said FROM (SELECT *, CASE {fits} END AS rule FROM u)),
t0 AS (SELECT host, path, count(*) AS n, count(said) AS l, count(*) FILTER (said = 'block') AS b, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, '' AS template, '' AS parent FROM p GROUP BY host, path)
{"".join(level(d) for d in range(1, DEPTH + 1))},
tree AS (SELECT host, path, l, b, CASE WHEN len(segs) > {DEPTH} THEN template || '/**' ELSE template END AS template, CASE WHEN len(segs) > {DEPTH} THEN template ELSE parent END AS parent FROM t{DEPTH}),
leaf AS (SELECT host, parent, template, sum(l) AS l, sum(b) AS b FROM tree GROUP BY ALL),
k AS (SELECT *, rate * (1.0::DOUBLE - rate) / (l + 2.0::DOUBLE) AS var FROM (SELECT *, (b + 1.0::DOUBLE) / (l + 2.0::DOUBLE) AS rate FROM leaf WHERE l > 0)),
s AS (SELECT *, CASE WHEN rate - lag(rate) OVER w > {Z}::DOUBLE * sqrt(var + lag(var) OVER w) THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY host, parent ORDER BY rate, template)),
g AS (SELECT *, sum(new) OVER (PARTITION BY host, parent ORDER BY rate, template ROWS UNBOUNDED PRECEDING) AS g FROM s),
known AS (SELECT host, template, sum(l) OVER q AS gl, sum(b) OVER q AS gb FROM g WINDOW q AS (PARTITION BY host, parent, g)),
base AS (SELECT (coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(l), 0) + 2.0::DOUBLE) AS base FROM leaf),
across AS (SELECT template, (sum(b) + {PULL}::DOUBLE * (SELECT base FROM base)) / (sum(l) + {PULL}::DOUBLE) AS prior FROM leaf GROUP BY template),
score AS (SELECT leaf.host, leaf.template, (coalesce(gb, 0) + {PULL}::DOUBLE * prior) / (coalesce(gl, 0) + {PULL}::DOUBLE) AS score
  FROM leaf LEFT JOIN known USING (host, template) JOIN across USING (template))
SELECT page_id, p.host, p.path, rule, coalesce(said, CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, tree.template
FROM p JOIN tree ON p.host = tree.host AND p.path = tree.path JOIN score ON score.host = tree.host AND score.template = tree.template
"""


SQL = _sql()
