"""Weight totals, their scales, and counts for the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import scale_class
from ..functions.exact import exact_sums

BY = ("classification_version", "index_ticker", "effective_date")


def weight_totals(df: DataFrame, by: tuple[str, ...] = BY, weight: str = "weight") -> DataFrame:
    """weight_total (DOUBLE) and scale of every group. Sums are exact and rounded once, so a total next to a limit never changes its class with the partitioning."""
    return exact_sums(df, by, weight, "weight_total").withColumn("scale", scale_class(F.col("weight_total")))


def scale_counts(totals: DataFrame) -> DataFrame:
    return totals.groupBy("scale").agg(F.count("*").alias("n"))


def unrecognized(totals: DataFrame) -> DataFrame:
    return totals.where("scale = 'unrecognized'")


def rows_per_day(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(date).agg(F.count("*").alias("n_rows"))


def summary(df: DataFrame, ticker: str, date: str) -> DataFrame:
    """One row: rows, exact distinct tickers and days."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(ticker).alias("n_tickers"), F.count_distinct(date).alias("n_dates"))
