import pytest
from pyspark.sql import functions as F

from qcloom.functions import text as S


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("t,n", [("1.2M subscribers", 1200000), ("458,000,000 views", 458000000), ("642 videos", 642), ("12K", 12000), ("1,204 Comments", 1204), ("", 0), (None, 0), ("none", 0), ("1.001M", 1000999), ("5 bots", 5000000000), ("1.2.3", 0)])
def test_parse_count(spark, t, n):
    assert one(spark, S.parse_count, t) == n


@pytest.mark.parametrize("t,d", [("2 days ago", 2), ("1 week ago", 7), ("3 weeks ago", 21), ("2 months ago", 60), ("8 Months ago", 240), ("1 year", 365), ("x", 365), (None, 365)])
def test_age(spark, t, d):
    assert one(spark, S.age_to_days, t) == d


@pytest.mark.parametrize("t,s", [("0:03", 3), ("10:48", 648), ("1:02:03", 3723), ("1:xx:03", 63), ("", 0), (None, 0)])
def test_clock(spark, t, s):
    assert one(spark, S.clock_to_seconds, t) == s


@pytest.mark.parametrize("t,id_column,out", [("=1+1", False, "'=1+1"), ("@mrbeast", True, "@mrbeast"), ("@mrbeast", False, "'@mrbeast"), ("@SUM(1)", True, "'@SUM(1)"), ("plain", False, "plain"), ("", False, ""), (None, False, None), ("-3", True, "'-3")])
def test_guard(spark, t, id_column, out):
    assert one(spark, lambda c: S.cell_guard(c, id_column), t) == out


@pytest.mark.parametrize("t,out", [("Spanish", "sp"), ("EN", "EN"), ("unknown", None), ("  ", None), (None, None)])
def test_language(spark, t, out):
    assert one(spark, S.clamp_language, t) == out


def test_publish_age(spark):
    as_of = F.lit("2026-05-22T20:50:47-07:00")
    assert one(spark, lambda c: S.publish_age(c, as_of), "2026-05-12T20:50:47-07:00") == 10
    for bad in ("May 12, 2026", "", None):
        assert one(spark, lambda c: S.publish_age(c, as_of), bad) == 365
    assert one(spark, lambda c: S.publish_age(c, as_of), "2026-06-01T00:00:00Z") == 0.04


def test_rest(spark):
    assert one(spark, S.strip, "\t a b \n") == "a b"
    assert one(spark, lambda c: S.risk_at_least(c, F.lit("medium")), "low") == "medium"
    assert one(spark, lambda c: S.risk_at_least(c, F.lit("low")), "high") == "high"
    assert one(spark, lambda c: S.clean_list(c, 2), [" A", "", None, "B ", "C"], "array<string>") == ["a", "b"]
    assert one(spark, S.mmss, 75.9, "double") == "1:15"
    assert one(spark, S.blank_cell, " NaN ") and not one(spark, S.blank_cell, "x")
