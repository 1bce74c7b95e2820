import json

import pytest
from pyspark.sql import functions as F

from qcloom.functions import vocab as V
from qcloom.operators import gate as G
from qcloom.operators import validate as VA


def hits(spark, **fields):
    d = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))
    return G.scan(d, {k: F.col(k) for k in fields}).first().hits


def test_scan(spark):
    assert [h.group for h in hits(spark, title="Best casino bonuses and free spins!")] == ["gambling"]
    assert hits(spark, title="Tuscany winery tour, light scattering physics, wineé") == []
    got = hits(spark, title="jackpot betting poker CASINO", description="beer", tags=None)
    assert [(h.field, h.group, h.term) for h in got] == [("title", "gambling", "casino"), ("description", "alcohol", "beer")]


def test_first_pattern_misses_nothing(spark):
    lexicon = {"a": ("A", "low", ["casino", "kill all", "c++"]), "b": ("B", "high", ["\u00e9clair", "Wine"])}
    texts = ["CASINO", "ca\u017fino", "xcasino", "casino_", "\u00e9casino", "(casino)", "\u212aill all", "c++", "c++x", "\u00c9CLAIR", "w\u0130ne", "wIne 7", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    every = d.select("i", *[F.coalesce(F.col("t").rlike(G.whole_word(G.literal(t))), F.lit(False)).alias(f"{g}{k}") for g, (_, _, ts) in lexicon.items() for k, t in enumerate(ts)])
    want = {(r.i, g) for r in every.collect() for g in "ab" if any(v for c, v in r.asDict().items() if c != "i" and c[0] == g)}
    got = {(r.i, h.group) for r in G.scan(d, {"t": F.col("t")}, lexicon).collect() for h in r.hits}
    assert got == want and (0, "a") in got and (9, "b") in got


def test_scan_by_join_agrees(spark):
    rows = [(1, "casino poker and how to make a bomb"), (2, "Wine, WINE"), (3, "nothing"), (4, None), (5, "free  spins"), (6, "kill all")]
    d = spark.createDataFrame(rows, "id int, text string")
    a = {(r.id, h.group, h.term) for r in G.scan(d, {"t": F.col("text")}).collect() for h in r.hits}
    b = {(r.id, r.group, r.term) for r in G.scan_by_join(d.withColumn("field", F.lit("t")), V.lexicon(spark)).collect()}
    assert a == b and len(a) == 4
    c = {(r.id, r.group, r.term) for r in G.scan_by_join(d.withColumn("field", F.lit("t")), V.lexicon(spark), 0).collect()}
    assert c == a


@pytest.mark.parametrize("risk,cats,text,out", [("low", ["Gambling"], "casino", "medium"), ("none", [], "casino", "low"), ("high", ["Alcohol"], "wine", "high"), ("none", [], "wine", "none"), ("none", ["Alcohol"], "wine", "low"), ("odd", [], "x", "odd")])
def test_floor(spark, risk, cats, text, out):
    d = spark.createDataFrame([(risk, cats, text)], "risk string, cats array<string>, text string")
    d = G.scan(d, {"title": F.col("text")})
    assert d.select(G.enforce_floor(F.col("risk"), F.col("cats"), F.col("hits")).alias("r")).first().r == out


def test_unsafe_category(spark):
    d = spark.createDataFrame([(False, ["Gambling", "Adult Content"]), (True, ["Gambling"]), (False, [])], "safe boolean, cats array<string>")
    assert [r.c for r in d.select(G.unsafe_category(F.col("safe"), F.col("cats")).alias("c")).collect()] == ["Adult Content", None, None]


BASE = {
    "tier_1": "Gaming", "tier_2": "FPS Gameplay", "tier_classification_reasoning": "r" * 300, "keywords": [" A", "b", "", "c", "d", "e", "f", "g", "h", "i"], "language": "en",
    "brand_safety": {"risk_level": "none", "triggered_categories": [], "explanation": "fine"}, "targeted_audience": {"age_group": "18-24", "gender": "Male", "interests": ["Games", " "]}, "suitable_age_group": "13+",
}


def normal(spark, policy=None, **over):
    raw = spark.createDataFrame([(json.dumps(BASE | over),)], "j string").select(F.lit("x").alias("id"), F.from_json("j", VA.RAW).alias("p")).select("id", "p.*")
    ok, bad = VA.normalize(raw, policy)
    return ok.first(), bad.first()


def test_normalize(spark):
    r, _ = normal(spark)
    assert (r.tier_1, r.tier_2, len(r.tier_classification_reasoning), r.keywords, r.language, r.audience_gender, r.audience_interests) == ("Gaming", "fps gameplay", 200, list("abcdefgh"), "en", "male", ["Games"])
    assert normal(spark, tier_1="Videogames")[0] is None and "Videogames" in normal(spark, tier_1="Videogames")[1].error
    for raw, tier in (("gaming", "Gaming"), ("Movies & Entertainment", "Entertainment"), ("food & cooking", "Food & Beverage"), ("Podcast", "Podcasts")):
        assert normal(spark, tier_1=raw)[0].tier_1 == tier
    kids = normal(spark, tier_1="Kids", kids_age_group="3-5 years")[0]
    assert (kids.kids_age_group, kids.audience_age_group) == ("3-5 years", None)
    assert normal(spark, tier_1="Kids", kids_age_group="toddlers")[0].kids_age_group is None
    grown = normal(spark, kids_age_group="3-5 years")[0]
    assert (grown.kids_age_group, grown.audience_age_group) == (None, "18-24")
    bad = normal(spark, brand_safety={"is_safe": True, "risk_level": "high", "triggered_categories": ["Gambling / betting", "x", "Gambling"]}, suitable_age_group="?")[0]
    assert (bad.is_safe, bad.triggered_categories, bad.suitable_age_group) == (False, ["Gambling"], "18+")
    assert normal(spark, brand_safety={"risk_level": "extreme"})[0].risk_level == "medium"
    policy = {"Podcasts": ("medium", "Political Content")}
    r = normal(spark, policy, tier_1="Podcasts")[0]
    assert (r.risk_level, r.triggered_categories, r.is_safe) == ("medium", ["Political Content"], False)
    assert normal(spark, policy, tier_1="Podcasts", brand_safety={"risk_level": "high"})[0].risk_level == "high"


def test_every_tier(spark):
    d = VA.resolve_tier(V.tiers(spark))
    assert d.where("tier = tier_1").count() == len(V.TIERS) == 29 and len(V.TIER_ALIASES) == 58
