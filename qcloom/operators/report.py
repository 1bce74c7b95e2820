"""Run reports and accuracy against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import norm

# Words that the filters of a report go by.
ONLY = {"unsafe": "unsafe", "not_safe": "unsafe", "brand_unsafe": "unsafe", "needs_review": "review", "review": "review", "needs review": "review", "error": "error", "errors": "error", "failed": "error"}
WIDE_SHOWN = ["id", "name", "tier_1", "brand_safety_is_safe", "brand_safety_risk_level", "needs_review", "confidence"]
QC_SHOWN = ["Channel ID", "Title", "Tier 1", "Brand Safety Status", "Brand Safety Risk Level", "Shorts", "Premium"]


def run_views(df: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """df with unsafe, review, error and tier, whatever its schema ('wide' or 'qc'), and the columns to show."""
    low = lambda c: F.lower(F.col(f"`{c}`").cast("string")) if c in df.columns else F.lit("")
    if schema == "qc":
        s = low("Brand Safety Status")
        flags, tier, shown = (s == "unsafe", F.lit(False), s == "error"), "Tier 1", QC_SHOWN
    else:
        flags, tier, shown = (low("brand_safety_is_safe") == "false", low("needs_review").isin("true", "1"), low("status") == "error"), "tier_1", WIDE_SHOWN
    t = F.col(f"`{tier}`") if tier in df.columns else F.lit(None).cast("string")
    d = df.withColumns({k: F.coalesce(f, F.lit(False)) for k, f in zip(("unsafe", "review", "error"), flags)}).withColumn("tier", t)
    return d, [c for c in shown if c in df.columns]


def show_results(df: DataFrame, schema: str = "wide", only: str | None = None, n: int = 15, top: int = 10) -> dict:
    """A summary (one row), the tiers, and the first rows that match; `note` where the filter can't be had.

    summary: total, unsafe, needs_review, errors, matched, truncated.
    """
    d, shown = run_views(df, schema)
    what, note, match = (only or "").strip().lower(), None, F.lit(True)
    if what in ONLY:
        match = F.col(ONLY[what])
        if schema == "qc" and ONLY[what] == "review":
            match, note = F.lit(True), "the QC output doesn't carry needs_review; showing everything instead"
    elif what:
        match = F.coalesce(F.lower("tier") == what, F.lit(False))
    summary = d.agg(
        F.count("*").alias("total"), F.count_if("unsafe").alias("unsafe"), F.count_if("review").alias("needs_review"), F.count_if("error").alias("errors"),
        F.count_if(match).alias("matched"), (F.count_if(match) > n).alias("truncated"),
    )
    return {"summary": summary, "tiers": top_tiers(d, "tier", top), "rows": d.where(match).select(*[F.col(f"`{c}`") for c in shown]).limit(n), "note": note}


def top_tiers(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("tier")).count().orderBy(F.desc("count"), "tier").limit(k)


def run_tally(rec: DataFrame) -> DataFrame:
    """done, errors, unsafe, review over all and, by grouping sets, for each tier_1 (null: all)."""
    tier = F.when(F.grouping("tier_1") == 0, F.coalesce("tier_1", F.lit("")))
    n = rec.rollup("tier_1").agg(
        tier.alias("tier"), F.count("*").alias("done"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.count_if(~F.col("brand_safety_is_safe")).alias("unsafe"), F.count_if("needs_review").alias("review")
    )
    return n.select(F.col("tier").alias("tier_1"), "done", "errors", "unsafe", "review")


def run_remaining(total: Column, done: Column, halted: Column, errors: Column) -> tuple[Column, Column, Column]:
    """(remaining, complete, why it stopped): halted before errors before incomplete."""
    left = F.greatest(total - done, F.lit(0))
    why = F.when(left == 0, F.lit("")).when(halted, F.lit("halted")).when(errors > 0, F.lit("errors")).otherwise(F.lit("incomplete"))
    return left, left == 0, why


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c != "id" and c in set(b.columns)]


def eval_fields(gold: DataFrame, pred: DataFrame, fields: str | None = None) -> list[str]:
    """The default list, every shared column ('auto'), or those named."""
    if fields is None:
        return V.EVAL_FIELDS
    if fields.strip().lower() == "auto":
        return shared_columns(gold, pred)
    return [f.strip() for f in fields.split(",") if f.strip()]


def accuracy_join(gold: DataFrame, pred: DataFrame, key: str = "id") -> DataFrame:
    """Inner join on the key; every other column as _gold or _pred. Repeated ids multiply, as joins do."""
    g = gold.select(key, *[F.col(f"`{c}`").cast("string").alias(f"{c}_gold") for c in gold.columns if c != key])
    p = pred.select(key, *[F.col(f"`{c}`").cast("string").alias(f"{c}_pred") for c in pred.columns if c != key])
    return g.join(p, key)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(norm(c), r"(?U)\s+"), lambda x: x != "")


def _keywords(c: Column) -> Column:
    parts = F.split(F.replace(norm(c), F.lit(";"), F.lit(",")), ",")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def keyword_overlap(gold: Column, pred: Column) -> Column:
    a, b = _keywords(gold), _keywords(pred)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.lit(5)), F.lit(1))


def accuracy(gold: DataFrame, pred: DataFrame, fields: str | None = None, gates: dict[str, float] | None = None) -> DataFrame:
    """(field, accuracy, gate, passed), all fields in one pass over the join. Fields that either side lacks, or in which no
    row has both values, are left out; tier_2 matches on any shared word; keyword_overlap@5 comes last."""
    d = accuracy_join(gold, pred)
    cols, gates = set(d.columns), V.GATES if gates is None else gates
    aggs = []
    for f in eval_fields(gold, pred, fields):
        if f"{f}_gold" not in cols or f"{f}_pred" not in cols:
            continue
        g, p = F.col(f"`{f}_gold`"), F.col(f"`{f}_pred`")
        same = F.arrays_overlap(_tokens(g), _tokens(p)) if f == "tier_2" else norm(g) == norm(p)
        aggs.append((f, F.avg(F.when(g.isNotNull() & p.isNotNull(), F.when(same, 1.0).otherwise(0.0)))))
    if {"keywords_gold", "keywords_pred"} <= cols:
        aggs.append(("keyword_overlap@5", F.avg(keyword_overlap(F.col("keywords_gold"), F.col("keywords_pred")))))
    if not aggs:
        return d.sparkSession.createDataFrame([], "field string, accuracy double, gate double, passed boolean")
    one = d.agg(*[c.alias(f"m{i}") for i, (_, c) in enumerate(aggs)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"m{i}").alias("accuracy"), F.lit(gates.get(f)).cast("double").alias("gate")) for i, (f, _) in enumerate(aggs)]))
    return one.select(rows.alias("r")).select("r.*").where("accuracy is not null").withColumn("passed", F.when(F.col("gate").isNotNull(), F.col("accuracy") >= F.col("gate")))
