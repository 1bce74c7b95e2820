"""Closed vocabularies. Order matters: tiers are in prompt order, categories in order of priority, terms in scan order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: they must equal the QC team's lists, in their order. ----

TIERS = [
    "Home Decor", "Business & Finance", "Food & Beverage", "Home Appliances", "Automobile", "Agriculture & Farming",
    "Kids", "Alcohol", "Education", "Career & Jobs", "Health & Wellness", "Movies", "Entertainment", "Style & Fashion",
    "Fitness", "Travel", "Science & Technology", "Gadgets", "Music", "Sports", "Extreme Sports", "Pets & Animals",
    "Gaming", "Real Estate", "Shopping", "Arts & Crafts", "Beauty", "Motivation", "Podcasts",
]
TIER_FALLBACK = "Entertainment"
TIER_ALIASES = {
    "automobiles": "Automobile", "auto": "Automobile", "cars": "Automobile", "podcast": "Podcasts", "pets": "Pets & Animals",
    "animals": "Pets & Animals", "movie": "Movies", "film": "Movies", "films": "Movies", "gadget": "Gadgets",
    "art & craft": "Arts & Crafts", "arts and crafts": "Arts & Crafts", "diy": "Arts & Crafts",
    "real estate & property": "Real Estate", "property": "Real Estate", "career": "Career & Jobs", "careers": "Career & Jobs",
    "jobs": "Career & Jobs", "agriculture": "Agriculture & Farming", "farming": "Agriculture & Farming",
    "home decor & interiors": "Home Decor", "interior design": "Home Decor", "appliances": "Home Appliances",
    "finance": "Business & Finance", "business": "Business & Finance", "movies & entertainment": "Entertainment",
    "vlogs": "Entertainment", "comedy": "Entertainment", "animation": "Entertainment", "lifestyle": "Entertainment",
    "news": "Entertainment", "global important days": "Entertainment", "global festivals": "Entertainment",
    "generational cohorts": "Entertainment", "religion": "Entertainment", "race & culture": "Entertainment",
    "gender and identity": "Entertainment", "rights and democracy": "Entertainment", "history": "Education",
    "science": "Science & Technology", "technology": "Science & Technology", "tech": "Science & Technology",
    "climate and planet": "Science & Technology", "food & cooking": "Food & Beverage", "food": "Food & Beverage",
    "cooking": "Food & Beverage", "beauty & makeup": "Beauty", "makeup": "Beauty", "fashion": "Style & Fashion",
    "style": "Style & Fashion", "health & fitness": "Health & Wellness", "health": "Health & Wellness",
    "wellness": "Health & Wellness", "mental health": "Health & Wellness", "gym": "Fitness", "nfl": "Sports",
    "gifting": "Shopping", "shopping & deals": "Shopping",
}
KIDS_BANDS = ["0-2 years", "3-5 years", "6-8 years", "9-12 years", "Teens"]
ADULT_BANDS = ["13-17", "18-24", "25-34", "35-44", "45-54", "55+", "general adult"]
GENDERS = ["male", "female", "mixed", "any"]
SENTIMENTS = ["positive", "neutral", "mixed", "negative"]
SUITABLE = ["all ages", "13+", "16+", "18+"]
RISKS = ["none", "low", "medium", "high"]
CATEGORIES = [
    "Adult Content", "Violent Content", "Hate Speech", "Profanity & Offensive Language", "Drugs & Tobacco", "Alcohol",
    "Gambling", "Political Content", "Misinformation", "Controversial Social Issues", "Dangerous Activities",
    "Sensational & Shocking Content",
]
POLICY_FLOOR: dict[str, tuple[str, str]] = {}  # tier -> (least risk, category); empty today, the mechanism stays
TRIGGER_LABELS = {
    "sexual / nudity": "Adult Content", "vulgarity / profanity": "Profanity & Offensive Language",
    "gambling / betting": "Gambling", "violence / weapons": "Violent Content", "illegal substances": "Drugs & Tobacco",
    "hate / extremism": "Hate Speech", "self-harm / dangerous acts": "Dangerous Activities", "misinformation": "Misinformation",
}
#: group -> (category, least risk, terms)
LEXICON = {
    "alcohol": ("Alcohol", "low", ["alcohol", "beer", "wine", "whiskey", "vodka", "liquor", "brewery", "spirits"]),
    "gambling": ("Gambling", "medium", ["gambling", "casino", "betting", "sportsbook", "poker", "lottery", "jackpot", "free spins", "satta"]),
    "adult": ("Adult Content", "high", ["onlyfans", "nsfw", "porn", "xxx", "stripper", "thirst trap", "fetish"]),
    "violence": ("Violent Content", "medium", ["gore", "graphic violence", "beheading", "massacre", "brutal fight"]),
    "weapons": ("Violent Content", "medium", ["firearms", "gun sale", "ammo", "explosives", "how to make a bomb"]),
    "drugs": ("Drugs & Tobacco", "medium", ["cocaine", "heroin", "meth", "cannabis", "marijuana", "weed", "ganja", "drug deal", "vape juice"]),
    "hate": ("Hate Speech", "high", ["hate speech", "ethnic cleansing", "white power", "kill all"]),
    "self_harm": ("Dangerous Activities", "high", ["suicide method", "self harm", "pro ana", "kill myself"]),
}
GATES = {"tier_1": 0.80, "language": 0.95, "brand_safety_is_safe": 0.90, "targeted_region": 0.85}
EVAL_FIELDS = ["tier_1", "tier_2", "language", "targeted_region", "brand_safety_is_safe", "kids_age_group", "is_premium_luxury"]
HEADER_WORDS = ["id", "type", "label", "name", "channelid", "videoid", "url"]
ID_HEADERS = [
    "id", "ids", "url", "urls", "link", "links", "channel", "channels", "channel_id", "channelid", "channel url", "channel_url",
    "video", "videos", "video_id", "videoid", "video url", "video_url", "handle", "handles",
]
QC_COLUMNS = [
    "Channel ID", "Title", "Subscribers", "Channel Country", "Brand Safety Status", "Brand Safety Risk Level", "Tier 1",
    "Tier 2", "Age Marking", "Language", "Shorts", "Premium",
]

# ---- End of fixed values. ----


def literal_map(d: dict) -> Column:
    """A small dictionary folded into the plan."""
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def one_of(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def tiers(spark: SparkSession) -> DataFrame:
    """ord, tier_1"""
    return spark.createDataFrame(list(enumerate(TIERS)), "ord int, tier_1 string")


def tier_names(spark: SparkSession) -> DataFrame:
    """key (lower case), tier: the vocabulary first, then aliases that it lacks."""
    known = {t.lower(): t for t in TIERS}
    return spark.createDataFrame([*known.items(), *((k, v) for k, v in TIER_ALIASES.items() if k not in known)], "key string, tier string")


def lexicon(spark: SparkSession, terms: dict | None = None) -> DataFrame:
    """group, ord, term, category, min_risk"""
    rows = [(g, i, t, c, r) for g, (c, r, ts) in (terms or LEXICON).items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "group string, ord int, term string, category string, min_risk string")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "ord int, category string")


def taxonomy(spark: SparkSession) -> DataFrame:
    """All vocabularies as one table: vocabulary, ord, value."""
    lists = {"tier_1": TIERS, "kids_age_group": KIDS_BANDS, "adult_age_band": ADULT_BANDS, "gender": GENDERS, "risk_level": RISKS, "safety_category": CATEGORIES, "suitable_age_group": SUITABLE}
    return spark.createDataFrame([(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)], "vocabulary string, ord int, value string")
