"""Sums of DOUBLEs that don't depend on the order of rows: exact, rounded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A double is cut into SLICES whole numbers of BITS bits each, of one band of its exponent and the bands below.
BITS, SLICES = 24, 4
HIGHEST, LIFT = 42, 10


def _power(band: Column) -> Column:
    """2 ** (BITS * band): of whole numbers, so the JVM's pow is exact."""
    return F.pow(F.lit(2.0), band * BITS)


def _sliced(df: DataFrame, value: str) -> DataFrame:
    """Adds __band and __s0 to __s3: value is the sum of s_k * 2 ** (BITS * (band - k)), exactly. Every step is exact:
    division by a power of two, the cut, and the rest."""
    v = F.col(value)
    tiny = F.abs(v) < 2.0**-800  # lifted by LIFT bands, so that powers stay normal numbers
    df = df.withColumn("__rest", F.when(tiny, v * 2.0 ** (BITS * LIFT)).otherwise(v))
    df = df.withColumn("__at", F.when(v == 0, 0).otherwise(F.least(F.lit(HIGHEST), F.floor(F.log2(F.abs("__rest")) / BITS))).cast("int"))
    for k in range(SLICES):
        unit = _power(F.col("__at") - k)
        df = df.withColumn(f"__s{k}", (F.col("__rest") / unit).cast("long"))
        df = df.withColumn("__rest", F.col("__rest") - F.col(f"__s{k}").cast("double") * unit)
    return df.withColumn("__band", F.when(tiny & (v != 0), F.col("__at") - LIFT).otherwise(F.col("__at"))).drop("__rest", "__at")


def _digits(sums: Column) -> Column:
    """Sums of bands, lowest first, as digits of BITS bits and a sign (0 or -1)."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(state: Column, s: Column) -> Column:
        total = s + state["carry"]
        return F.struct(F.shiftright(total, BITS).alias("carry"), F.concat(state["digits"], F.array(total.bitwiseAND(F.lit((1 << BITS) - 1)))).alias("digits"))

    return F.aggregate(sums, start, step)


def exact_sums(df: DataFrame, by: tuple[str, ...], value: str, out: str) -> DataFrame:
    """One row per group: the exact sum of its DOUBLEs, rounded once to the nearest; the same bits however rows are dealt or ordered.

    Nulls don't count; a group of nulls has a null. NaN, or infinities of both signs, give NaN. Partial sums are
    whole numbers (BIGINT, for up to 5e11 rows of a group), by group and band of the exponent, so they combine on the map side."""
    v = F.col(value).cast("double")
    plain = F.when(F.abs(v) < float("inf"), v)  # neither NaN nor infinite
    rows = _sliced(df.select(*by, v.alias("__v"), plain.alias("__plain")), "__plain")
    odd = {"__nan": F.isnan("__v"), "__up": F.col("__v") == float("inf"), "__down": F.col("__v") == float("-inf"), "__n": F.col("__v").isNotNull()}
    parts = rows.groupBy(*by, "__band").agg(*(F.sum(f"__s{k}").alias(f"__s{k}") for k in range(SLICES)), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in odd.items()))
    bands = F.collect_list(F.when(F.col("__band").isNotNull(), F.struct("__band", F.array(*(f"__s{k}" for k in range(SLICES))).alias("s"))))  # ninety at most
    groups = parts.groupBy(*by).agg(bands.alias("__list"), *(F.sum(n).alias(n) for n in odd))
    groups = groups.select(*by, _total(F.col("__list"), *(F.col(n) for n in odd)).alias(out))
    # Groups are whole already, so this moves nothing; but a filter on the sum stays above it, and does not compute it once more.
    return groups.groupBy(*by).agg(F.first(out).alias(out))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(parts: Column, nan: Column, up: Column, down: Column, count: Column) -> Column:
    """The sum of a group's parts (band and its SLICES sums), and of what is not finite."""

    def bands(x: Column) -> Column:
        low = F.array_min(F.transform(x, lambda p: p["__band"])) - (SLICES - 1)
        high = F.array_max(F.transform(x, lambda p: p["__band"])) + 2  # room for carries

        def total(band: Column) -> Column:
            own = lambda p: F.when((p["__band"] >= band) & (p["__band"] - band < SLICES), F.get(p["s"], p["__band"] - band)).otherwise(0)
            return F.aggregate(x, F.lit(0).cast("long"), lambda acc, p: acc + own(p))

        return F.struct(low.alias("low"), F.transform(F.sequence(low, high), total).alias("sums"))

    def signed(b: Column) -> Column:
        minus = lambda m: F.struct(b["low"].alias("low"), m.alias("minus"), _digits(F.transform(b["sums"], lambda s: F.when(m, -s).otherwise(s)))["digits"].alias("digits"))
        return _let(_digits(b["sums"])["carry"] < 0, minus)

    def rounded(d: Column, top: Column) -> Column:
        digit = lambda k: F.when(top >= k, F.get(d["digits"], top - k)).otherwise(0).cast("decimal(38,0)")
        head = digit(0)
        for k in range(1, SLICES):
            head = (head * F.lit(1 << BITS).cast("decimal(10,0)")).cast("decimal(38,0)") + digit(k)
        rest = F.exists(F.slice(d["digits"], F.lit(1), F.greatest(top - (SLICES - 1), F.lit(0))), lambda x: x != 0)  # what decides a tie
        whole = ((head * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)") + F.when(rest, 1).otherwise(0)).cast("decimal(38,0)").cast("double")
        power = (d["low"] + top - (SLICES - 1)) * BITS - 1
        size = whole * F.pow(F.lit(2.0), F.ceil(power / 2)) * F.pow(F.lit(2.0), F.floor(power / 2))
        return F.when(top < 0, F.lit(0.0)).otherwise(F.when(d["minus"], F.negative(size)).otherwise(size))

    top = lambda d: F.array_max(F.transform(d["digits"], lambda x, i: F.when(x != 0, i).otherwise(-1)))
    finite = _let(bands(parts), lambda b: _let(signed(b), lambda d: _let(top(d), lambda t: rounded(d, t))))
    return (
        F.when((nan > 0) | ((up > 0) & (down > 0)), F.lit(float("nan")))
        .when(up > 0, F.lit(float("inf"))).when(down > 0, F.lit(float("-inf"))).when(count > 0, finite)
    )
