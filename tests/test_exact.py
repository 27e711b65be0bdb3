from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_sums
from tidemark.functions.search import rank_in
from tidemark.operators import quality


def numbers(draw, kind):
    if kind == "weights":
        return [round(draw.random() / 9, draw.choice((2, 4, 9))) for _ in range(200)]
    if kind == "wide":
        return [draw.choice((-1, 1)) * draw.random() * 10.0 ** draw.randrange(-30, 30) for _ in range(150)]
    if kind == "cancel":
        half = [draw.random() * 2.0 ** draw.randrange(-60, 60) for _ in range(70)]
        return [*half, *(-x for x in half), draw.random()]
    if kind == "ends":
        return [draw.choice((5e-324, -5e-324, 2.2e-308, 1e-300, -3e-290, 1e300, -1e300, 4.4e305, 0.0, -0.0, 1.0)) for _ in range(60)]
    return [draw.choice((2.0**48, 2.0**48 * (1 - 2**-53), 2.0**-24, -(2.0**24), 2.0**24 + 1, 3.0)) for _ in range(90)]


@pytest.mark.parametrize("kind", ["weights", "wide", "cancel", "ends", "edges"])
def test_sums_are_exact(spark, kind):
    draw = random.Random(kind)
    groups = {k: numbers(draw, kind) for k in range(12)}
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, x double")
    for parts in (1, 4, 64):
        got = {r["k"]: r["total"] for r in exact_sums(df.repartition(parts), ("k",), "x", "total").collect()}
        assert {k: v.hex() for k, v in got.items()} == {k: (math.fsum(xs) + 0.0).hex() for k, xs in groups.items()}


def test_sums_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (1, None), (2, nan), (2, 1.0), (3, inf), (3, 1.0), (4, inf), (4, -inf), (5, -inf), (6, 0.0), (7, None), (7, 2.5), (None, 1.0), (None, 2.0)]
    got = {r["k"]: r["t"] for r in exact_sums(spark.createDataFrame(rows, "k int, x double"), ("k",), "x", "t").collect()}
    assert math.isnan(got.pop(2)) and math.isnan(got.pop(4))
    assert got == {1: None, 3: inf, 5: -inf, 6: 0.0, 7: 2.5, None: 3.0}
    assert exact_sums(spark.createDataFrame([], "k int, x double"), ("k",), "x", "t").count() == 0


def test_a_total_next_to_a_limit_keeps_its_class(spark):
    """A thousand weights that sum to 1.01 up to rounding: their class is the same for every order and partitioning."""
    rows = [(k % 3, 1.01 / 1000 * (1 + (k % 7) * 1e-16)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, weight double")
    seen = {tuple(sorted((r["k"], r["weight_total"].hex(), r["scale"]) for r in quality.weight_totals(df.repartition(parts, F.rand(parts)), ("k",)).collect())) for parts in (1, 4, 64)}
    assert len(seen) == 1


def test_rank_in(spark):
    rows = spark.createDataFrame([(x,) for x in (-1, 0, 5, 9, 10, 99, None)], "x int")
    for bounds in ([], [5], [0, 5, 9, 10], list(range(0, 90, 3))):
        got = [r[1] for r in rows.select("x", rank_in(bounds, len(bounds), F.col("x"))).collect()]
        assert got == [None if x is None else sum(b <= x for b in bounds) for x in (-1, 0, 5, 9, 10, 99, None)]
