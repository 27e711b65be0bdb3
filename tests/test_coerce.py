from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coerce

NUMBERS = [
    ("1", 1.0), (" 2 ", 2.0), ("1e3", 1000.0), ("+5", 5.0), ("1.", 1.0), (".5", 0.5), ("-0.25", -0.25), ("inf", float("inf")), ("-inf", float("-inf")), ("Infinity", float("inf")),
    ("nan", None), ("", None), ("abc", None), ("1,000", None), ("0x10", None), ("--", None), ("True", None), ("1d", None), ("2f", None), ("1_000", None), ("1e400", None), (None, None),
]


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_numbers(spark):
    assert column(spark, [a for a, _ in NUMBERS], coerce.number_or_null) == [b for _, b in NUMBERS]


def test_dates(spark):
    values = ["2021-12-13", "20211213", "bad", None, "2020", "2020-01-02 15:00:00", "20210230"]
    assert column(spark, values, coerce.date_or_null) == [date(2021, 12, 13), date(2021, 12, 13), None, None, None, None, None]
    assert column(spark, values, coerce.compact_date) == [None, date(2021, 12, 13), None, None, None, None, None]
    assert column(spark, values, coerce.bad_date) == [False, False, True, False, True, True, True]


def test_exact_integers(spark):
    values = ["3.0", "abc", "1.5", "inf", "9007199254740993", None, "300", "-128", "1e2"]
    assert column(spark, values, coerce.exact_long) == [3, None, None, None, 9007199254740993, None, 300, -128, 100]
    assert column(spark, values, coerce.inexact_long) == [False, False, True, True, False, False, False, False, False]
    assert column(spark, values, coerce.exact_tiny) == [3, None, None, None, None, None, None, -128, 100]
    assert column(spark, values, coerce.inexact_tiny) == [False, False, True, True, True, False, True, False, False]


@pytest.mark.parametrize(("total", "scale"), [(1.0, "ratio"), (1.009, "ratio"), (1.01, "unrecognized"), (0.99, "unrecognized"), (100.5, "percent"), (99.5, "percent"), (50.0, "unrecognized")])
def test_scale(spark, total, scale):
    assert column(spark, [total], coerce.scale_class, "double") == [scale]


def test_symbol(spark):
    rows = [("600000", "SH", "S"), ("AAPL", None, "X"), (None, "SH", "Z"), ("000001", "SZ", "Y")]
    df = spark.createDataFrame(rows, "t string, s string, i string")
    assert {r[0] for r in df.select(coerce.symbol(F.col("t"), F.col("s"), F.col("i"))).collect()} == {"600000.SH", "X", "Z", "000001.SZ"}
