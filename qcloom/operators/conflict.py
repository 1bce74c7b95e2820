"""Conflicts between sources, votes, and how a resolution is applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cap, norm, risk_name, risk_rank, text
from ..functions.vocab import RISKS
from .gate import is_safe

CONFLICT = "struct<field:string,left_source:string,left_value:string,right_source:string,right_value:string,note:string>"
VISION = """ok boolean, frames array<struct<position:string,description:string>>, on_screen_text array<string>, content_format string,
production_quality string, visual_kids_signals struct<present:boolean,signals:array<string>>,
visual_safety_flags array<struct<category:string,evidence:string,severity:string>>,
people struct<apparent_age_range:string,notes:string>, brands_or_products_visible array<string>,
premium_luxury_signals array<string>, visible_language string, error string"""


def _conflict(field: str, left: str, left_value: Column, right: str, right_value: Column, note: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(field).alias("field"), F.lit(left).alias("left_source"), left_value.alias("left_value"), F.lit(right).alias("right_source"), right_value.alias("right_value"), (note if note is not None else null).alias("note"))


def kids_conflict(tier: Column, vision: Column, note: Column | None = None) -> Column:
    signals = F.array_join(F.slice(F.coalesce(vision["visual_kids_signals"]["signals"], F.array().cast("array<string>")), 1, 3), ", ")
    seen = F.concat(F.lit("Kids (visual kids signals: "), signals, F.lit(")"))
    when = F.coalesce(vision["ok"], F.lit(False)) & F.coalesce(vision["visual_kids_signals"]["present"], F.lit(False)) & ~tier.eqNullSafe(F.lit("Kids"))
    return F.when(when, _conflict("tier_1", "content_analyst", tier, "vision_analyst", seen, note))


def risk_conflict(risk: Column, vision: Column) -> Column:
    flags = F.filter(F.coalesce(vision["visual_safety_flags"], F.array().cast("array<struct<category:string,evidence:string,severity:string>>")), lambda f: f["severity"].isin("medium", "high"))
    when = F.coalesce(vision["ok"], F.lit(False)) & (F.size(flags) > 0) & (risk == "none")
    return F.when(when, _conflict("brand_safety.risk_level", "content_analyst", F.lit("none"), "vision_analyst", F.to_json(F.slice(flags, 1, 3))))


def language_conflict(language: Column, vision: Column) -> Column:
    seen = vision["visible_language"]
    when = F.coalesce(vision["ok"], F.lit(False)) & (text(seen) != "") & (text(language) != "") & (seen != language)
    return F.when(when, _conflict("language", "content_analyst", language, "vision_analyst", seen))


def vote_conflicts(tier: Column, voted: Column, share: Column, votes: Column | None = None) -> tuple[Column, Column]:
    """A verdict against a majority; no majority. A missing share counts as 0 for the first and 1 for the second."""
    against = (text(voted) != "") & ~tier.eqNullSafe(voted) & (F.coalesce(share, F.lit(0.0)) >= 0.5)
    said = F.concat(voted, F.lit(" (vote share "), share.cast("string"), F.lit(")"))
    split = F.coalesce(share, F.lit(1.0)) < 0.5
    return (
        F.when(against, _conflict("tier_1", "synthesizer", tier, "draft_aggregate", said)),
        F.when(split, _conflict("tier_1", "synthesizer", tier, "votes", votes if votes is not None else voted, F.lit("no majority among sampled-video briefs"))),
    )


def detect_conflicts(tier: Column, risk: Column, language: Column, vision: Column, voted: Column | None = None, share: Column | None = None) -> Column:
    """All conflicts of a row in order; empty: no judge needed."""
    found = [kids_conflict(tier, vision), risk_conflict(risk, vision), language_conflict(language, vision)]
    if voted is not None:
        found += vote_conflicts(tier, voted, share)
    return F.array_compact(F.array(*found))


def channel_vote(briefs: DataFrame, key: str, tier: str = "tier_1", risk: str | None = None) -> DataFrame:
    """(key, tier_1, tier_1_vote_share, votes, worst_risk): the most voted tier (ties: first by name), and the worst risk."""
    n = briefs.groupBy(key, F.col(tier).alias("t")).agg(F.count("*").alias("n"), (F.max(risk_rank(F.col(risk))) if risk else F.lit(0)).alias("r"))
    got = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("t").alias("t"))).alias("top"), F.sum("n").alias("votes"), F.max("r").alias("r"))
    return got.select(key, F.col("top.t").alias("tier_1"), (-F.col("top.k") / F.col("votes")).alias("tier_1_vote_share"), "votes", risk_name(F.col("r")).alias("worst_risk"))


def apply_resolution(records: DataFrame, resolutions: DataFrame, key: str = "id", revalidate: bool = False) -> DataFrame:
    """Records with a judge's answers laid over them. resolutions: key, resolved_fields map, judge_notes.

    Only a risk from the vocabulary is taken. revalidate: a tier outside the vocabulary isn't taken either.
    """
    from .validate import resolve_tier

    r = resolutions.select(F.col(key).alias("_k"), F.col("resolved_fields").alias("_f"), F.col("judge_notes").alias("_n"))
    d = records.join(r, F.col(key) == F.col("_k"), "left")
    f = lambda k: F.try_element_at("_f", F.lit(k))
    tier = f("tier_1")
    if revalidate:
        d = resolve_tier(d.withColumn("_tier", tier), "_tier", "_known")
        tier = F.col("_known")
    risk = F.lower(F.coalesce(F.nullif(f("brand_safety.risk_level"), F.lit("")), f("risk_level")))
    notes = text(F.col("_n"))
    joined = F.regexp_replace(F.concat(F.coalesce("qc_notes", F.lit("")), F.lit(" | Judge: "), notes), r"^[ |]+|[ |]+$", "")
    d = d.withColumns({
        "tier_1": F.coalesce(tier, "tier_1"), "tier_2": F.coalesce(F.lower(f("tier_2")), "tier_2"),
        "language": F.coalesce(F.lower(F.substring(f("language"), 1, 2)), "language"),
        "risk_level": F.when(risk.isin(*RISKS), risk).otherwise(F.col("risk_level")),
        "kids_age_group": F.coalesce(f("kids_age_group"), "kids_age_group"),
        "qc_notes": F.when(notes != "", cap(joined, 400)).otherwise(F.col("qc_notes")), "judge_invoked": F.col("_k").isNotNull(),
    })
    return d.withColumn("is_safe", is_safe(F.col("risk_level"))).drop("_k", "_f", "_n", "_tier", "_known")
