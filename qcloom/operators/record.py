"""Records: confidence, review flags, assembly, and the twelve-column projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_guard
from ..functions.vocab import QC_COLUMNS
from .extract import is_short_video
from .gate import enforce_floor, is_safe, unsafe_category

# What each missing signal costs.
PENALTIES = {"no_transcript": 0.15, "no_vision": 0.10, "recovered": 0.10, "judged": 0.20, "split_vote": 0.10, "mixed_language": 0.10}
REVIEW_BELOW = 0.6


def confidence(no_transcript: Column, no_vision: Column, recovered: Column, judged: Column, split_vote: Column | None = None, mixed_language: Column | None = None) -> Column:
    """1 less the penalties, two places, 0 at least."""
    flags = {"no_transcript": no_transcript, "no_vision": no_vision, "recovered": recovered, "judged": judged, "split_vote": split_vote, "mixed_language": mixed_language}
    c = F.lit(1.0)
    for k, f in flags.items():
        if f is not None:
            c = c - F.when(F.coalesce(f, F.lit(False)), F.lit(PENALTIES[k])).otherwise(F.lit(0.0))
    return F.greatest(F.round(c, 2), F.lit(0.0))


def review_video(transcript_source: Column, frames_method: Column) -> Column:
    return (transcript_source == "none") | (frames_method == "none")


def review_channel(vision_ok: Column, n_titles: Column, n_grid_shots: Column) -> Column:
    return ~vision_ok | (n_titles < 5) | (n_grid_shots == 0)


def review_threshold(review: Column, conf: Column, below: float = REVIEW_BELOW) -> Column:
    return review | (conf < below)


def age_marking(kids: Column, suitable: Column) -> Column:
    band = F.trim(F.coalesce(suitable, F.lit("")))
    return F.when(F.coalesce(kids, F.lit("")) != "", kids).when(band == "all ages", F.lit("All Ages")).otherwise(band)


def safety_status(status: Column, safe: Column) -> Column:
    return F.when(status == "ERROR", F.lit("Error")).when(safe.isNull(), F.lit("")).when(safe, F.lit("Safe")).otherwise(F.lit("Unsafe"))


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("Yes")).otherwise(F.lit("No"))


def qc_row(rec: DataFrame, *keep: str) -> DataFrame:
    """The twelve columns in their order, guarded; `keep` names further columns to keep beside them."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    risk = F.when(F.col("status") == "ERROR", F.lit("")).otherwise(F.initcap(F.trim(e("brand_safety_risk_level"))))
    values = [
        F.col("id"), e("name"), F.coalesce(F.col("subscribers"), F.lit(0)).cast("long"), e("country"), safety_status(F.col("status"), F.col("brand_safety_is_safe")), risk,
        e("tier_1"), e("tier_2"), age_marking(F.col("kids_age_group"), F.col("suitable_age_group")), e("language"), yes_no(F.col("is_shorts")), yes_no(F.col("is_premium_luxury")),
    ]
    guarded = [c if n == "Subscribers" else cell_guard(c, n == "Channel ID") for n, c in zip(QC_COLUMNS, values)]
    return rec.select(*keep, *(c.alias(n) for n, c in zip(QC_COLUMNS, guarded)))


def keep_last(df: DataFrame, keys: str | list[str], seq: str) -> DataFrame:
    """One row per key, the last by seq. max_by over the whole row: combines before the shuffle, so that a key with many
    rewrites is no hot task."""
    keys = [keys] if isinstance(keys, str) else keys
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(f"`{seq}`"))
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(row.alias("_row")).select("_row.*")


def merge_prior(prior: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Earlier rows and this run's, the last of each key, in the columns of the new ones."""
    both = prior.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_at", F.struct("_run", F.col(seq)))
    return keep_last(both, key, "_at").select(*new.columns)


def flatten_record(rec: DataFrame, guard: bool = True) -> DataFrame:
    """Lists joined by `; `, texts guarded: one cell per field."""
    out = []
    for f in rec.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        c = F.array_join(c, "; ") if kind == "array<string>" else c
        out.append((cell_guard(c, f.name == "id") if guard and kind in ("string", "array<string>") else c).alias(f.name))
    return rec.select(*out)


def status_band(status: Column, safe: Column, review: Column) -> Column:
    """The colour class of a row: error before unsafe before review."""
    return F.when(status == "ERROR", F.lit("error")).when(~safe, F.lit("unsafe")).when(review, F.lit("review")).otherwise(F.lit("safe"))


CLASSIFIED = ["tier_1", "tier_2", "tier_classification_reasoning", "language", "targeted_region", "kids_age_group", "audience_age_group", "audience_gender", "audience_interests", "keywords", "lookalike_keywords", "content_themes", "topics", "sentiment", "summary", "suitable_age_group", "is_premium_luxury"]


def assemble(extracts: DataFrame, valid: DataFrame, kind: str, run_id: str, key: str = "id") -> DataFrame:
    """Extract rows and validated output (with risk_level, triggered_categories, judge_invoked, tier_recovered, vision_ok)
    to records of a kind ('video' or 'channel'). Failed extracts and items without valid output are ERROR rows.

    extracts: key, ok, error, hits, name, and of a video: transcript_source, frames_method, duration_s, is_live; of a
    channel: n_titles, n_grid_shots, is_shorts_only. Further columns stay.
    """
    v = valid.select(F.col(key).alias("_id"), *[c for c in valid.columns if c != key and c not in extracts.columns])
    d = extracts.join(v, F.col(key) == F.col("_id"), "left")
    failed = ~F.col("ok")
    reason = F.when(failed, F.coalesce(F.nullif("error", F.lit("")), F.lit("extraction failed"))).when(F.col("_id").isNull(), F.coalesce(F.col("validation_error") if "validation_error" in d.columns else F.lit(None).cast("string"), F.lit("validation: no valid output")))
    d = d.withColumn("error", F.coalesce(reason, F.lit(""))).withColumn("status", F.when(reason.isNull(), F.lit("OK")).otherwise(F.lit("ERROR")))
    bad = F.col("status") == "ERROR"
    risk = enforce_floor(F.col("risk_level"), F.col("triggered_categories"), F.col("hits"))
    d = d.withColumn("brand_safety_risk_level", F.when(bad, F.lit("none")).otherwise(risk))
    d = d.withColumn("brand_safety_is_safe", F.when(~bad, is_safe(F.col("brand_safety_risk_level"))))
    d = d.withColumn("brand_unsafe_category", F.when(~bad, unsafe_category(F.col("brand_safety_is_safe"), F.col("triggered_categories"))))
    if kind == "video":
        short, silent, review = is_short_video(F.col("duration_s"), F.col("is_live")), F.col("transcript_source") == "none", review_video(F.col("transcript_source"), F.col("frames_method"))
    else:
        short, silent, review = F.col("is_shorts_only"), None, review_channel(F.coalesce("vision_ok", F.lit(False)), F.col("n_titles"), F.col("n_grid_shots"))
    conf = confidence(silent, ~F.coalesce("vision_ok", F.lit(False)), F.col("tier_recovered"), F.col("judge_invoked"))
    return d.withColumns({
        "type": F.lit(kind), "run_id": F.lit(run_id), "is_shorts": F.when(bad, False).otherwise(F.coalesce(short, F.lit(False))),
        "confidence": F.when(bad, 0.0).otherwise(conf), "needs_review": bad | review_threshold(F.coalesce(review, F.lit(True)), conf),
    }).drop("_id")


def video_record(extracts: DataFrame, valid: DataFrame, run_id: str, key: str = "id") -> DataFrame:
    return assemble(extracts, valid, "video", run_id, key)


def channel_record(extracts: DataFrame, valid: DataFrame, run_id: str, key: str = "id") -> DataFrame:
    return assemble(extracts, valid, "channel", run_id, key)


def error_record(items: DataFrame, error: Column, run_id: str, key: str = "id") -> DataFrame:
    """Any failure as a row that shows."""
    return items.withColumns({"status": F.lit("ERROR"), "error": error, "needs_review": F.lit(True), "confidence": F.lit(0.0), "run_id": F.lit(run_id)}) if key in items.columns else items


def extract_only_record(extracts: DataFrame, run_id: str, note: str = "extract only") -> DataFrame:
    return extracts.withColumns({"status": F.when(F.col("ok"), "OK").otherwise("ERROR"), "comment": F.lit(note), "needs_review": ~F.col("ok"), "run_id": F.lit(run_id)})
