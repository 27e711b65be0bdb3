"""Loosely typed text to strict types; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINITE = r"^\s*+[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+\s*+$"  # nothing to go back to, so no part does
PLAIN = r"^\s*+[+-]?+(?:\d{1,300}+(?:\.\d*+)?+|\.\d++)\s*+$"  # of these none is too large
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def number_or_null(c: Column) -> Column:
    """DOUBLE; anything that is not a plain number is null, NaN too, and so is a number too large.

    Where a value has several uses, name it in a projection first, so that it is parsed once."""
    text = c.cast("string")
    value = text.try_cast("double")
    return F.when(text.rlike(PLAIN), value).when(text.rlike(FINITE), F.when(F.abs(value) < float("inf"), value)).when(text.rlike(INFINITE), value)


def date_or_null(c: Column) -> Column:
    """DATE of yyyy-MM-dd or yyyyMMdd text; a column of dates or of timestamps keeps its day. Text of a timestamp is null."""
    text = c.cast("string")
    text = F.when(F.typeof(c).startswith("timestamp"), F.left(text, F.lit(10))).otherwise(text)  # the type is known before any row
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")))


def compact_date(c: Column) -> Column:
    """DATE of exactly eight digits that are a real day, else null."""
    return F.when(c.rlike("^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd"))


def bad_date(c: Column) -> Column:
    """True where there is text but no date in it."""
    return c.isNotNull() & date_or_null(c).isNull()


def exact_long(c: Column, value: Column | None = None) -> Column:
    """BIGINT; text of an integer goes straight, other numbers by DOUBLE when they are whole; else null.

    value: number_or_null of c, where it is known already."""
    text, value = F.trim(c.cast("string")), number_or_null(c) if value is None else value
    whole = (F.abs(value) < 9.2e18) & (F.floor(value) == value)
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.when(whole, value.try_cast("bigint")))


def inexact_long(c: Column, value: Column | None = None) -> Column:
    """True for numbers that are no BIGINT: fractions, infinities, out of range."""
    return (number_or_null(c) if value is None else value).isNotNull() & exact_long(c, value).isNull()


def exact_tiny(c: Column, value: Column | None = None) -> Column:
    return exact_long(c, value).try_cast("tinyint")


def inexact_tiny(c: Column, value: Column | None = None) -> Column:
    """True for numbers that are no TINYINT."""
    return (number_or_null(c) if value is None else value).isNotNull() & exact_tiny(c, value).isNull()


def symbol(ticker: Column, suffix: Column, sec_id: Column) -> Column:
    """ticker.suffix where both are known, else the security's own id."""
    return F.coalesce(F.concat(ticker.cast("string"), F.lit("."), suffix), sec_id.cast("string"))


def scale_class(total: Column) -> Column:
    """Whether weights sum to one, to a hundred, or to neither; limits in DOUBLE."""
    near = lambda target, limit: F.abs(total - F.lit(float(target))) <= F.lit(float(limit))
    return F.when(near(1, 0.01), "ratio").when(near(100, 0.5), "percent").otherwise("unrecognized")


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def path_parts(c: Column) -> tuple[Column, Column]:
    """Text of year and month, as partitions are named."""
    return F.date_format(c, "yyyy"), F.date_format(c, "MM")
