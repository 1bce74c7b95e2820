"""Column functions on text, counts, ages and risk levels; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import RISKS, literal_map


def let(c: Column, f) -> Column:
    """f of c with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind on either side."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c: Column) -> Column:
    """Stripped, null as empty."""
    return F.coalesce(strip(c), F.lit(""))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_count(c: Column) -> Column:
    """`1.2M subscribers`, `1,204 Comments` -> whole number; 0 where there is none."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[,\s]", "")
    number = F.regexp_extract(s, "([0-9.]+)([KMBkmb]?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(s, "([0-9.]+)([KMBkmb]?)", 2))
    by = F.when(unit == "K", 1_000.0).when(unit == "M", 1_000_000.0).when(unit == "B", 1_000_000_000.0).otherwise(1.0)
    return F.coalesce((number * by).cast("long"), F.lit(0).cast("long"))


AGES = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}


def age_to_days(c: Column) -> Column:
    """`3 weeks ago` -> 21.0; unknown -> 365.0."""
    pattern = r"(?i)([0-9]+)\s+(second|minute|hour|day|week|month|year)"
    s = F.coalesce(c, F.lit(""))
    n = F.regexp_extract(s, pattern, 1).try_cast("double")
    return F.coalesce(n * F.try_element_at(literal_map(AGES), F.lower(F.regexp_extract(s, pattern, 2))), F.lit(365.0))


def clock_to_seconds(c: Column) -> Column:
    """`1:02:03` -> 3723.0; parts that aren't digits are left out; none -> 0.0."""
    parts = F.filter(F.split(text(c), "[:.]"), lambda p: p.rlike("^[0-9]+$"))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))


def mmss(c: Column) -> Column:
    return F.concat(F.floor(c / 60).cast("string"), F.lit(":"), F.lpad(F.floor(F.pmod(c, F.lit(60.0))).cast("string"), 2, "0"))


def publish_age(raw: Column, as_of: Column) -> Column:
    """Days from an ISO timestamp to as_of, 0.04 at least; 365 where it can't be read."""
    ts = F.try_to_timestamp(F.coalesce(raw, F.lit("")))
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0.04))).otherwise(F.lit(365.0))


def views_per_day(views: Column, days: Column) -> Column:
    return F.bround(views / F.greatest(days, F.lit(1.0)), 1)


def publish_date(raw: Column) -> Column:
    return F.split_part(F.coalesce(raw, F.lit("")), F.lit("T"), F.lit(1))


def cell_guard(c: Column, id_column: bool = False) -> Column:
    """Text that a spreadsheet would read as a formula gets a quote in front; a plain @handle in an id column doesn't."""
    risky = c.rlike("^[=+@-]")
    if id_column:
        risky = risky & ~c.rlike("^@[A-Za-z0-9._-]+$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def risk_rank(c: Column) -> Column:
    """0 to 3; unknown words are 0."""
    return F.coalesce(F.try_element_at(literal_map({r: i for i, r in enumerate(RISKS)}), c), F.lit(0))


def risk_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), rank + 1)


def risk_at_least(level: Column, floor: Column) -> Column:
    return F.when(risk_rank(level) >= risk_rank(floor), level).otherwise(floor)


def clamp_language(c: Column) -> Column:
    """`unknown` -> null; more than two letters are cut to two, in lower case."""
    s = or_null(text(c))
    return F.when(F.lower(s) == "unknown", None).when(F.length(s) > 2, F.lower(F.substring(s, 1, 2))).otherwise(s)


def clean_list(c: Column, n: int, lower: bool = True, drop_empty: bool = True) -> Column:
    one = (lambda x: F.lower(text(x))) if lower else text
    a = F.transform(F.coalesce(c, F.array().cast("array<string>")), one)
    return prefix(F.filter(a, lambda x: x != "") if drop_empty else a, n)


def prefix(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def cap(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def norm(c: Column) -> Column:
    return F.lower(text(c))


def blank_cell(c: Column) -> Column:
    """Null, white space or the text nan."""
    return norm(c).isin("", "nan")
