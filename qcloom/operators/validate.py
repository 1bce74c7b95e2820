"""Closed-vocabulary validation of model output: one broadcast join on the tier, then plain expressions.

Raw columns: see RAW. A row whose tier can't be resolved is rejected, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import cap, clamp_language, clean_list, norm, or_null, risk_at_least, text
from .gate import is_safe

RAW = """summary string, hook string, tier_1 string, tier_2 string, tier_classification_reasoning string, sentiment string,
language string, targeted_region string, primary_audience string, kids_age_group string, suitable_age_group string, qc_notes string,
content_themes array<string>, topics array<string>, target_industries array<string>, keywords array<string>,
lookalike_keywords array<string>, comment_sentiment struct<overall:string,summary:string,sample_count:int>,
brand_safety struct<is_safe:boolean,risk_level:string,triggered_categories:array<string>,explanation:string>,
targeted_audience struct<age_group:string,gender:string,interests:array<string>>, is_premium_luxury boolean"""


def resolve_tier(df: DataFrame, col: str = "tier_1", into: str = "tier") -> DataFrame:
    """df with `tier`: the exact value, else the one equal but for case, else its alias, else null."""
    names = F.broadcast(V.tier_names(df.sparkSession)).select(F.col("key").alias("_key"), F.col("tier").alias(into))  # under 100 rows
    return df.join(names, norm(F.col(col)) == F.col("_key"), "left").drop("_key")


def risk_domain(c: Column) -> Column:
    r = F.when(norm(c) == "", F.lit("none")).otherwise(norm(c))
    return F.when(r.isin(*V.RISKS), r).otherwise(F.lit("medium"))


def map_triggers(c: Column) -> Column:
    """Prompt labels to categories; only known ones, each once, in order of first sight."""
    one = lambda x: F.coalesce(F.try_element_at(V.literal_map(V.TRIGGER_LABELS), norm(x)), text(x))
    mapped = F.transform(F.coalesce(c, F.array().cast("array<string>")), one)
    return F.array_distinct(F.filter(mapped, lambda x: x.isin(*V.CATEGORIES)))


def kids_band(tier: Column, raw: Column) -> Column:
    return F.when((tier == "Kids") & text(raw).isin(*V.KIDS_BANDS), text(raw))


def adult_band(tier: Column, raw: Column) -> Column:
    return F.when(tier != "Kids", F.when(text(raw).isin(*V.ADULT_BANDS), text(raw)).otherwise(F.lit("general adult")))


def suitable_age(safe: Column, raw: Column) -> Column:
    return F.when(norm(raw).isin(*V.SUITABLE), norm(raw)).when(safe, F.lit("all ages")).otherwise(F.lit("18+"))


def closed(raw: Column, values: list[str], default: str) -> Column:
    return F.when(norm(raw).isin(*values), norm(raw)).otherwise(F.lit(default))


def policy_floor(df: DataFrame, tier: str, risk: str, triggered: str, policy: dict | None = None) -> DataFrame:
    """Tiers that a policy lists get its least risk and its category. policy: tier -> (risk, category)."""
    policy = V.POLICY_FLOOR if policy is None else policy
    if not policy:
        return df
    least = F.try_element_at(V.literal_map({k: v[0] for k, v in policy.items()}), F.col(tier))
    category = F.try_element_at(V.literal_map({k: v[1] for k, v in policy.items()}), F.col(tier))
    more = F.when(category.isin(*V.CATEGORIES) & ~F.array_contains(triggered, category), F.concat(triggered, F.array(category))).otherwise(F.col(triggered))
    return df.withColumn(risk, F.when(least.isNotNull(), risk_at_least(F.col(risk), least)).otherwise(F.col(risk))).withColumn(triggered, F.coalesce(more, triggered))


def normalize(raw: DataFrame, policy: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of raw model output; other columns of raw stay. Rejected rows get `error`."""
    df = resolve_tier(raw)
    ok = df.where("tier is not null")
    ok = ok.withColumn("risk_level", risk_domain(F.col("brand_safety.risk_level"))).withColumn("triggered_categories", map_triggers(F.col("brand_safety.triggered_categories")))
    ok = policy_floor(ok, "tier", "risk_level", "triggered_categories", policy)
    tier, safe = F.col("tier"), is_safe(F.col("risk_level"))
    own = {
        "tier_1": tier, "tier_2": or_null(norm(F.col("tier_2"))),
        "tier_classification_reasoning": or_null(cap(text(F.col("tier_classification_reasoning")), 200)),
        "keywords": clean_list(F.col("keywords"), 8), "lookalike_keywords": clean_list(F.col("lookalike_keywords"), 8),
        "language": clamp_language(F.col("language")), "targeted_region": or_null(text(F.col("targeted_region"))),
        "kids_age_group": kids_band(tier, F.col("kids_age_group")), "audience_age_group": adult_band(tier, F.col("targeted_audience.age_group")),
        "audience_gender": closed(F.col("targeted_audience.gender"), V.GENDERS, "any"),
        "audience_interests": clean_list(F.col("targeted_audience.interests"), 5, lower=False),
        "is_safe": safe, "brand_safety_explanation": cap(text(F.col("brand_safety.explanation")), 400),
        "suitable_age_group": suitable_age(safe, F.col("suitable_age_group")), "sentiment": closed(F.col("sentiment"), V.SENTIMENTS, "neutral"),
        "summary": text(F.col("summary")), "hook": text(F.col("hook")), "primary_audience": text(F.col("primary_audience")),
        "content_themes": clean_list(F.col("content_themes"), 5, lower=False, drop_empty=False), "topics": clean_list(F.col("topics"), 10, lower=False, drop_empty=False),
        "target_industries": clean_list(F.col("target_industries"), 6, lower=False, drop_empty=False),
        "is_premium_luxury": F.coalesce("is_premium_luxury", F.lit(False)), "qc_notes": cap(text(F.col("qc_notes")), 400),
    }
    spent = {"tier", "brand_safety", "targeted_audience"}
    others = [F.col(f"`{c}`") for c in ok.columns if c not in spent and c not in own and c not in ("risk_level", "triggered_categories")]
    valid = ok.select(*others, *(c.alias(k) for k, c in own.items()), "risk_level", "triggered_categories")
    error = F.concat(F.lit("validation: unrecoverable tier_1 '"), text(F.col("tier_1")), F.lit("'"))
    return valid, df.where("tier is null").drop("tier").withColumn("error", error)
