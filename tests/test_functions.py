"""Literal cases of the scalar functions and the fit rule."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallywork.functions import parsing as P
from tallywork.functions import scalars as S
from tallywork.operators import opportunity as O


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, pivot, expected", [
    ("2/8/16", 99, date(2016, 8, 2)), ("10/1/94", 16, date(1994, 1, 10)), ("1/1/1800", 16, date(1800, 1, 1)),
    ("31/2/16", 99, None), ("nan", 16, None), ("", 16, None), (None, 16, None), (" 2/8/16 ", 99, date(2016, 8, 2)),
    ("1999-01-02", 99, None), ("5/5/16", 16, date(2016, 5, 5)), ("5/5/17", 16, date(1917, 5, 5)), ("1/2/16\n", 99, None)])
def test_parse_dmy(spark, text, pivot, expected):
    assert one(spark, text, lambda x: P.parse_dmy(x, pivot)) == expected


@pytest.mark.parametrize("text, expected", [
    ("143207", 14 * 3600 + 32 * 60 + 7), ("0", 0), ("240000", None), ("250000", None), ("6000", None), ("59", 59),
    ("x", None), (None, None)])
def test_parse_hhmmss(spark, text, expected):
    assert one(spark, text, P.parse_hhmmss) == expected


@pytest.mark.parametrize("text, expected", [("1.5E3", 1500), ("-5", -5), ("", None), ("1,000", None), (" 2.50 ", 2.5),
                                            ("12345678901234567", 12345678901234567), ("1" * 20, int("1" * 20)), ("1" * 21, None)])
def test_to_money(spark, text, expected):
    assert one(spark, text, P.to_money) == expected


@pytest.mark.parametrize("text, expected", [("  new--delhi ", "NEW DELHI"), (" .", None), ("", None), (None, None)])
def test_norm_location(spark, text, expected):
    assert one(spark, text, P.norm_location) == expected


@pytest.mark.parametrize("dob, as_of, expected", [
    (date(1996, 2, 29), date(2015, 2, 28), 18), (date(1996, 2, 29), date(2015, 3, 1), 19),
    (date(1990, 9, 16), date(2016, 9, 16), 26), (date(1990, 9, 17), date(2016, 9, 16), 25)])
def test_age(spark, dob, as_of, expected):
    assert one(spark, dob, lambda x: S.age_at(x, as_of), "date") == expected


def test_mask_id(spark):
    assert one(spark, "C5841053", S.mask_id) == "C5***053"


@pytest.mark.parametrize("score, expected", [(95.0, "Call this week"), (90.0, "Call within 2 weeks"),
                                             (89.0, "Include in campaign")])
def test_contact_plan(spark, score, expected):
    assert one(spark, score, S.contact_plan, "double") == expected


@pytest.mark.parametrize("value, expected", [(99.9, 40), (100.0, 41), (0.0, 1)])
def test_width_bucket(spark, value, expected):
    assert one(spark, value, lambda x: F.width_bucket(x, F.lit(0.0), F.lit(100.0), F.lit(40)), "double") == expected


def test_fit_rule(spark):
    rows = spark.createDataFrame([(1, 0.80, True), (2, 0.80, True), (3, 0.70, False), (4, 0.50, False), (5, None, True)],
                                 "i int, pr double, hard boolean")
    alone = O.fit_of([O.at_least(F.col("pr"), 0.75)], 0.10)
    both = O.fit_of([O.at_least(F.col("pr"), 0.75), (F.col("hard"), None)], 0.10)
    got = rows.orderBy("i").select(alone.alias("a"), both.alias("b")).collect()
    assert [r.a for r in got] == [1.0, 1.0, 0.5, 0.0, 0.0]
    assert [r.b for r in got] == [1.0, 1.0, 0.0, 0.0, 0.0]
