"""Lexicon scan and risk floors.

The lexicon is small and fixed for a run, so it is folded into the plan: its terms are looked for in the lower-cased text as plain
substrings, which costs about a nanosecond a byte and term, and those that are there by the pattern for whole words.
A scan is therefore one narrow pass without join or explode of misses; lexicons too long for a plan go through scan_by_join.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, risk_name, risk_rank
from ..functions.vocab import CATEGORIES, LEXICON, literal_map

BROADCAST_TERMS = 200_000  # some 200 bytes each
FOLDED_TERMS = 500  # more terms than this are better joined

HIT = "array<struct<group:string,term:string,field:string,category:string,min_risk:string>>"


def whole_word(term: str) -> str:
    """A Java pattern for a term as whole words, letters of any script counting as such."""
    return rf"(?iU)(?<!\w)(?:{term})(?!\w)"


def literal(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


ODD, PLAIN = "\u017f\u0131\u0130\u212a", "siik"  # letters that regular expressions take for ASCII ones in any case


def folded(c: Column) -> Column:
    """Lower case, with the odd letters as ASCII ones; texts without any of them aren't translated."""
    odd = F.lit(False)
    for x in ODD:
        odd = odd | c.contains(x)
    return F.lower(F.when(odd, F.translate(c, ODD, PLAIN)).otherwise(c))


TERM = "array<struct<group:string,term:string,category:string,min_risk:string,low:string,pattern:string>>"


def _terms(lexicon: dict) -> Column:
    """All terms in order of groups and lists, as one literal. low: null for terms beyond ASCII, which only their pattern finds."""
    rows = [
        {"group": group, "term": t, "category": category, "min_risk": risk, "low": t.lower() if t.isascii() else None, "pattern": whole_word(literal(t))}
        for group, (category, risk, terms) in lexicon.items() for t in terms
    ]
    return F.from_json(F.lit(json.dumps(rows)), TERM)


def scan(df: DataFrame, fields: dict[str, Column], lexicon: dict = LEXICON, into: str = "hits") -> DataFrame:
    """df with `hits`: for each field and group, the first term that occurs. Order: fields, then groups.

    The hits come out of a generator of one row, which the optimizer moves nothing through: else filters on them, such as the
    one that explode() brings, would have all texts scanned again.
    """

    def of(field: str, c: Column) -> Column:
        found = let(folded(c), lambda low: F.filter(_terms(lexicon), lambda t: (t["low"].isNull() | F.contains(low, t["low"])) & F.regexp_like(c, t["pattern"])))
        # terms come group by group: the first of each is one behind another group's
        first = let(found, lambda f: F.filter(f, lambda t, i: (i == 0) | (F.get(f, i - 1)["group"] != t["group"])))
        return F.transform(first, lambda t: F.struct(t["group"].alias("group"), t["term"].alias("term"), F.lit(field).alias("field"), t["category"].alias("category"), t["min_risk"].alias("min_risk")))

    empty = F.array().cast(HIT)
    if not lexicon:
        return df.withColumn(into, empty)
    return df.withColumn(into, F.explode_outer(F.array(F.concat(*[F.when(c.isNotNull(), of(f, c)).otherwise(empty) for f, c in fields.items()]))))


def scan_by_join(texts: DataFrame, lexicon: DataFrame, few: int = BROADCAST_TERMS) -> DataFrame:
    """(id, field, group, term, category, min_risk) for texts (id, field, text) and a lexicon table of any length.

    A text's distinct words are equi-joined with the terms' first words; only the few texts and terms that meet there
    are looked at again, and longer terms are checked on the text itself. Up to `few` terms (counted) are broadcast, so that the
    words of texts aren't shuffled; with more, both sides are.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda w: w != "")
    lex = lexicon.withColumn("words", split(F.col("term"))).withColumn("key", F.get("words", F.lit(0)))
    seen = texts.select("id", "field", F.explode(F.array_distinct(split(F.col("text")))).alias("key"))
    met = seen.join(F.broadcast(lex) if lex.limit(few + 1).count() <= few else lex, "key").drop("key")
    longer = met.where(F.size("words") > 1).join(texts, ["id", "field"])
    longer = longer.where(F.regexp_like("text", F.concat(F.lit(r"(?iU)(?<!\w)\Q"), "term", F.lit(r"\E(?!\w)")))).select(met.columns)
    hit = met.where(F.size("words") == 1).union(longer)
    first = F.min(F.struct("ord", "term", "category", "min_risk"))
    return hit.groupBy("id", "field", "group").agg(first.alias("m")).select("id", "field", "group", "m.term", "m.category", "m.min_risk")


def video_fields(title="title", description="description", keywords="keywords", transcript="transcript") -> dict[str, Column]:
    return {"title": F.col(title), "description": F.col(description), "tags": F.array_join(keywords, " "), "transcript": F.substring(F.col(transcript), 1, 20000)}


def channel_fields(title="title", description="description", keywords="channel_keywords", titles="titles") -> dict[str, Column]:
    return {"title": F.col(title), "description": F.col(description), "tags": F.col(keywords), "recent_titles": F.array_join(titles, " ")}


# Fixed value: the line that follows a list of hits.
ASK = "Address each hit in your brand_safety verdict: confirm it, or explain why it is a false positive in this context."


def hits_block(hits: Column) -> Column:
    line = lambda h: F.concat(F.lit("- term '"), h["term"], F.lit("' ("), h["group"], F.lit(" → "), h["category"], F.lit(") found in "), h["field"])
    return F.when(F.size(hits) > 0, F.concat(F.array_join(F.transform(hits, line), "\n"), F.lit("\n" + ASK))).otherwise(F.lit(""))


def enforce_floor(risk: Column, triggered: Column, hits: Column) -> Column:
    """A hit whose category the model named raises the risk to the group's least; another of medium or more lifts `none`
    to `low`. Greatest of ranks, so that the order of hits doesn't matter."""
    named = F.filter(hits, lambda h: F.array_contains(triggered, h["category"]))
    other = F.exists(hits, lambda h: ~F.array_contains(triggered, h["category"]) & h["min_risk"].isin("medium", "high"))
    floor = F.array_max(F.transform(named, lambda h: risk_rank(h["min_risk"])))
    lifted = F.greatest(F.coalesce(floor, F.lit(0)), F.when(other, 1).otherwise(0))
    return F.when(lifted > risk_rank(risk), risk_name(lifted)).otherwise(risk)


def is_safe(risk: Column) -> Column:
    return risk.isin("none", "low")


def unsafe_category(safe: Column, triggered: Column) -> Column:
    """The triggered category of highest priority; null where safe."""
    prio = literal_map({c: i for i, c in enumerate(CATEGORIES)})
    best = F.array_min(F.transform(triggered, lambda c: F.struct(F.coalesce(F.try_element_at(prio, c), F.lit(99)).alias("p"), c.alias("c"))))
    return F.when(~safe, best["c"])
