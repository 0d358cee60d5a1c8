"""Scalar functions, one table each."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def values(spark, inputs, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in rows.select("i", expr.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "plain", "signed"),
    [
        ("$1,234.50", "1234.50", "1234.50"), ("-5.00", "-5.00", "-5.00"), ("5.00 CR", "5.00", "-5.00"), ("(7.25)", "7.25", "-7.25"), (".99", "0.99", "0.99"),
        ("12-34", "1234", "1234"), ("abc", None, "0"), ("", None, "0"), (None, None, "0"),
    ],
)
def test_money(spark, text, plain, signed):
    assert values(spark, [text], S.money("x")) == [None if plain is None else Decimal(plain)]
    assert values(spark, [text], S.signed_money("x")) == [Decimal(signed)]


def test_dates(spark):
    d = datetime.date
    texts = ["01/05/2024", "1/5/24", "2024-01-05", "1-5-2024", "January 5, 2024", "Jan 5 2024", "5/1/99", "nonsense", None]
    assert values(spark, texts, S.date("x")) == [d(2024, 1, 5)] * 6 + [d(1999, 5, 1), None, None]


def test_texts(spark):
    assert values(spark, ["Total  Due: 5%"], S.lookup_text("x")) == ["total due 5"]
    assert values(spark, ["A b-1 (2)"], S.account_key("x")) == ["Ab12"]
    assert values(spark, ["a.b (c)  d"], S.regex_escape("x")) == [r"a\.b\s+\(c\)\s+d"]
    assert values(spark, ["  x ", " ", None], S.trimmed("x")) == ["x", None, None]
    assert values(spark, ['a,"b"', "c"], S.csv_field("x")) == ['"a,""b"""', "c"]
    assert values(spark, ["unlimited", "--", "1,000", None], S.limit_text("x")) == ["-1", "-1", "1000", "-1"]
    assert values(spark, ["", "kitten"], S.similarity("x", F.lit("sitting"))) == pytest.approx([0, 1 - 3 / 7])


def test_json(spark):
    assert values(spark, ['x ```{"a": 1}``` y', "none"], S.json_outer("x")) == ['{"a": 1}', None]
    m = S.map_get(S.json_map("x"), "B", "a")
    assert values(spark, ['{"A": "1"}', '{"b": " "}', "bad"], m) == ["1", None, None]
