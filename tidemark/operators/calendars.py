"""Which days are open, which are missing, and how to fetch them.

A calendar has thousands of rows. Calendars of several exchanges are keyed by exchange_cd, and
their windows are partitioned by it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coerce import compact_date
from ..functions.search import rank_in
from ..sources.catalogs import CUT_OVER, NEW, OLD

MOST_DAYS = 20
EXCHANGE = "exchange_cd"


def every_day(first: Column, last: Column) -> Column:
    """Explodes to one row per calendar day."""
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))


def open_days(calendar: DataFrame, start: str | date, end: str | date) -> DataFrame:
    """trade_date of open days, both ends included; with exchange_cd where the calendar has several exchanges."""
    of = [c for c in (EXCHANGE,) if c in calendar.columns]
    inside = (F.col("is_open") == 1) & F.col("calendar_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return calendar.where(inside).select(*of, F.col("calendar_date").alias("trade_date")).distinct()


def missing_days(days: DataFrame, existing: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Days without a stored partition, for each value of by; a day that brought no rows stays missing."""
    return days.join(existing.select(*by, "trade_date").distinct(), [*by, "trade_date"], "left_anti")


def version_of(day: Column, cut: date = CUT_OVER) -> Column:
    return F.when(day >= F.lit(cut), NEW).otherwise(OLD)


def chunk_days(days: DataFrame, size: int = MOST_DAYS, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds chunk: groups of size days in date order, from 0, within each value of by."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("trade_date"))
    return days.withColumn("chunk", F.floor((place - 1) / size).cast("int"))


def islands(days: DataFrame, missing: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Missing days with island: runs that follow each other in the calendar, however many days apart.

    by: columns of the exchange. Each has its own calendar, positions and island numbers, and windows
    are partitioned by it; without by there is one calendar, and one task has its days."""
    order = Window.partitionBy(*by).orderBy("trade_date")
    gaps = missing.select(*by, "trade_date").distinct().withColumn("gap", F.lit(True))
    placed = days.withColumn("position", F.row_number().over(order)).join(gaps, [*by, "trade_date"], "left").where("gap")
    start = F.col("position") - F.row_number().over(order)
    return placed.withColumn("start", start).withColumn("island", F.dense_rank().over(Window.partitionBy(*by).orderBy("start")) - 1).drop("position", "start", "gap")


def plan_backfill(days: DataFrame, existing: DataFrame, size: int = MOST_DAYS, cut: date = CUT_OVER, by: tuple[str, ...] = ()) -> DataFrame:
    """trade_date, island, version, chunk of each missing day, for each value of by.

    An island is split at the cut-over and then into chunks, so a first-to-last range
    of any (by, island, version, chunk) never covers a stored day."""
    tagged = islands(days, missing_days(days, existing, by), by).withColumn("version", version_of(F.col("trade_date"), cut))
    return chunk_days(tagged, size, (*by, "island", "version"))


def backfill_ranges(plan: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plan.groupBy(*by, "island", "version", "chunk").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count("*").alias("n_days"))


def version_windows(spark: SparkSession, start: str, end: str, cut: date = CUT_OVER) -> DataFrame:
    """window_id, version, start_date, end_date: the range cut at the cut-over and after every 31 December.

    start and end: eight digits. A bad date, or a start after the end, is an error."""
    first, last = spark.range(1).select(compact_date(F.lit(start)), compact_date(F.lit(end))).first()
    if first is None or last is None:
        raise ValueError(f"not a date of eight digits: {start if first is None else end}")
    if first > last:
        raise ValueError(f"start {start} is after end {end}")
    eras = spark.createDataFrame([(OLD, first, last, True), (NEW, first, last, False)], "version string, lo date, hi date, old boolean")
    lo = F.when(F.col("old"), F.col("lo")).otherwise(F.greatest("lo", F.lit(cut)))
    hi = F.when(F.col("old"), F.least("hi", F.date_sub(F.lit(cut), 1))).otherwise(F.col("hi"))
    eras = eras.select("version", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    years = eras.withColumn("y", F.explode(F.sequence(F.year("lo"), F.year("hi"))))
    cuts = years.select("version", F.greatest("lo", F.make_date("y", F.lit(1), F.lit(1))).alias("start_date"), F.least("hi", F.make_date("y", F.lit(12), F.lit(31))).alias("end_date"))
    return cuts.select(F.row_number().over(Window.orderBy("start_date")).alias("window_id"), "version", "start_date", "end_date")


def window_place(day: Column, windows: Sequence[tuple[date, date]]) -> Column:
    """Place (from 0) of the window that holds the day; null outside of all.

    windows: first and last days, in order, without overlap: some dozens, so a binary search in an
    expression instead of a range join."""
    if not windows:
        return F.lit(None).cast("int")
    at = rank_in([a for a, _ in windows], len(windows), day) - 1
    return F.when(day <= F.get(F.array(*(F.lit(b) for _, b in windows)), at), at)


def covers_month_end(start: Column, end: Column) -> Column:
    """Whether the range holds the last day of a month; the first month decides."""
    return F.last_day(start) <= end
