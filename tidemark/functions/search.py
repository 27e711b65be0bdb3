"""Binary search of a value in a short sorted list, as an expression: no join."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_in(bounds: Sequence[Any] | Column, size: int, value: Column) -> Column:
    """How many of the sorted bounds are at most value; null where value is.

    bounds: plain values in order, or a column of such an array, of size elements. The steps
    halve, so a row costs log2(size) comparisons of the value's own type."""
    array = bounds if isinstance(bounds, Column) else F.array(*(F.lit(b) for b in bounds))
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    if not steps:
        return F.when(value.isNotNull(), F.lit(0))
    ahead = lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at)
    return F.when(value.isNotNull(), F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), ahead))
