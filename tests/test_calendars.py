from __future__ import annotations

from datetime import date, timedelta

import pytest

from tidemark.operators import calendars


def frame(spark, days):
    return spark.createDataFrame([(d,) for d in days], "trade_date date")


def test_open_days_are_inclusive(spark):
    cal = spark.createDataFrame([(date(2024, 1, d), int(d not in (6, 7))) for d in range(1, 11)], "calendar_date date, is_open int")
    got = sorted(r[0].day for r in calendars.open_days(cal, "2024-01-05", "2024-01-09").collect())
    assert got == [5, 8, 9]


def test_islands_follow_the_calendar(spark):
    open_ = [date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10)]  # a weekend between
    plan = calendars.plan_backfill(frame(spark, open_), frame(spark, [open_[2], open_[5]]))
    got = {}
    for r in plan.collect():
        got.setdefault(r["island"], []).append(r["trade_date"].day)
    assert [sorted(v) for _, v in sorted(got.items())] == [[2, 3], [5, 8], [10]]


def test_island_across_the_cut_over(spark):
    cut = date(2021, 12, 13)
    days = [cut + timedelta(d) for d in range(-45, 45)]
    ranges = calendars.backfill_ranges(calendars.plan_backfill(frame(spark, days), frame(spark, [])))
    got = [(r["version"], r["n_days"]) for r in ranges.orderBy("start_date").collect()]
    assert got == [("SW2014", 20), ("SW2014", 20), ("SW2014", 5), ("SW2021", 20), ("SW2021", 20), ("SW2021", 5)]


def test_version_windows(spark):
    rows = calendars.version_windows(spark, "20140305", "20230401").orderBy("window_id").collect()
    assert len(rows) == 11
    assert [(str(r["start_date"]), str(r["end_date"])) for r in rows if r["start_date"].year == 2021] == [("2021-01-01", "2021-12-12"), ("2021-12-13", "2021-12-31")]
    assert [r["version"] for r in rows] == ["SW2014"] * 8 + ["SW2021"] * 3


@pytest.mark.parametrize(("start", "end"), [("20240102", "20240101"), ("2021-12-13", "20220101"), ("20210230", "20220101")])
def test_bad_ranges(spark, start, end):
    with pytest.raises(ValueError):
        calendars.version_windows(spark, start, end)


def test_month_end(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(date(2024, 5, 2), date(2024, 5, 30)), (date(2024, 5, 2), date(2024, 5, 31))], "a date, b date")
    assert [r[0] for r in df.orderBy("b").select(calendars.covers_month_end(F.col("a"), F.col("b"))).collect()] == [False, True]
