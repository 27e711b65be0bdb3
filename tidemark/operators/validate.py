"""Validation as explicit aggregates; the first failing rule of the first failing window wins.

Rules of single rows are counted by the job that stages them; the rest in one pass per shape
(keys, days, totals) over all windows at once, so the number of jobs doesn't grow with the
windows. What reaches the driver is one row per window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..schemas import WEIGHTS, Table, unused
from ..sources.catalogs import index_catalog
from .calendars import covers_month_end

ROW_RULES = ("unknown_ticker", "bad_date", "outside_window", "null_key", "bad_weight", "negative_weight")
LADDER = ("empty_window", *ROW_RULES, "duplicate_key", "incomplete_snapshot", "bad_total")


class ValidationError(ValueError):
    """rule: name from the ladder; window: its id, or None; detail: an example."""

    def __init__(self, rule: str, window: int | None = None, detail: str | None = None):
        super().__init__(f"{rule}" + (f" in window {window}" if window is not None else "") + (f": {detail}" if detail else ""))
        self.rule, self.window, self.detail = rule, window, detail


@dataclass(frozen=True)
class Failure:
    window: int
    rule: str
    detail: str | None


def duplicate_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with n_rows; nulls are equal to each other."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def rule_counts(df: DataFrame, rules: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """How many rows break each rule, in one aggregate."""
    return df.groupBy(*by).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()))


def unknown_keys(df: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    """Distinct non-null keys that the catalog lacks."""
    keys = df.select(*on).distinct()
    for c in on:
        keys = keys.where(F.col(c).isNotNull())
    return keys.join(F.broadcast(catalog.select(*on)), on, "left_anti")


def has_bit(bitmap: Column, position: Column) -> Column:
    """Whether a bitmap (as the bitmap aggregates make it) has a position, counted from 0."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) != 0


def snapshot_gaps(df: DataFrame, expected: DataFrame, by: list[str], member: str) -> DataFrame:
    """Groups whose members are not exactly the expected ones: sorted missing and extra.

    expected: the `by` columns it shares and a column `members`, an array. A catalog: its names,
    some hundreds and 32,768 at most, come to the driver. A group without any row is not seen.

    The names are numbered in order; a row sets its name's bit by a broadcast lookup, and groups
    merge their bitmaps on the map side, whatever the number of rows. Only names that nothing
    expects are collected, as a set."""
    shared = [c for c in by if c in expected.columns]
    place, name, bits, other = (unused(c, [*df.columns, *expected.columns]) for c in ("place", "name", "bits", "other"))
    names = sorted(r[0] for r in expected.select(F.explode("members")).distinct().collect())
    if len(names) > 32_768:
        raise ValueError("more names than a bitmap has bits")
    numbered = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(names)), f"{place} int, {name} string"))
    rows = df.where(F.col(member).isNotNull()).join(numbered, F.col(member) == F.col(name), "left")
    found = rows.groupBy(*by).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(place) + 1)).alias(bits), F.collect_set(F.when(F.col(place).isNull(), F.col(member))).alias(other))
    joined = found.withColumn("__all", F.lit(1)).join(F.broadcast(expected.withColumn("__all", F.lit(1))), ["__all", *shared])
    every = F.array(*(F.lit(n) for n in names)).cast("array<string>")
    present = F.transform(F.filter(F.array(*(F.lit(k) for k in range(len(names)))).cast("array<int>"), lambda p: has_bit(F.col(bits), p)), lambda p: F.get(every, p))
    gaps = joined.withColumn("missing", F.array_except("members", present)).withColumn("extra", F.array_union(F.array_except(present, "members"), other))
    return gaps.where((F.size("missing") > 0) | (F.size("extra") > 0)).select(*by, F.array_sort("missing").alias("missing"), F.array_sort("extra").alias("extra"))


def equity_rules(raw: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Raw bars with the numbers that the rules need, parsed once, under free names; and the rules."""
    deals, flag = unused("deals", raw.columns), unused("open flag", raw.columns)
    c = F.col
    rows = raw.withColumns({deals: coerce.number_or_null(c("dealAmount")), flag: coerce.number_or_null(c("isOpen"))})
    return rows, {"bad_date": coerce.bad_date(c("tradeDate")), "inexact_count": coerce.inexact_long(c("dealAmount"), c(deals)), "inexact_flag": coerce.inexact_tiny(c("isOpen"), c(flag))}


def judge(found: dict[str, int], rules: tuple[str, ...], table: Table) -> None:
    """Raises for the first rule of which there is a breach."""
    for rule in rules:
        if found[rule]:
            raise ValidationError(rule, detail=f"{found[rule]} rows of {table.name}" + (f", e.g. {found['example']}" if rule == "unknown_ticker" else ""))


def weight_flags() -> dict[str, Column]:
    """Rules of single rows of weights: on raw columns, start_date, end_date and known (the ticker is in the window's catalog)."""
    c = F.col
    weight, day = coerce.number_or_null(c("weight")), coerce.date_or_null(c("effDate"))
    return {
        "unknown_ticker": c("ticker").isNotNull() & ~c("known"),
        "bad_date": day.isNull(),
        "outside_window": ~day.between(c("start_date"), c("end_date")),
        "null_key": c("ticker").isNull() | c("consID").isNull() | c("consTickerSymbol").isNull() | c("effDate").isNull(),
        "bad_weight": weight.isNull(),
        "negative_weight": weight < 0,
    }


def check_weights(rows: DataFrame, windows: DataFrame, totals: DataFrame) -> tuple[Failure | None, dict[int, int]]:
    """The first failure, windows in order and then the ladder (None if all is well), and the rows of each window.

    rows: processed, with window_id, version and the flags of `weight_flags`. totals: weight totals by window. One row per window reaches the driver."""
    c, w = F.col, "window_id"
    catalog = index_catalog(rows.sparkSession, broad=False)
    flags = rows.groupBy(w).agg(*(F.count_if(F.coalesce(c(f), F.lit(False))).alias(f) for f in ROW_RULES), F.count("*").alias("rows"), F.min(F.when(c("unknown_ticker"), c("index_ticker"))).alias("ticker"))
    keys = duplicate_keys(rows, (w, *WEIGHTS.key)).groupBy(w).agg(F.count("*").alias("duplicate_key"))
    expected = catalog.groupBy("version").agg(F.array_sort(F.collect_set("catalog_ticker")).alias("members"))
    gaps = snapshot_gaps(rows, expected, [w, "version", "effective_date"], "index_ticker")
    text = F.concat(F.col("effective_date").cast("string"), F.lit(" missing "), F.concat_ws(",", "missing"), F.lit(" extra "), F.concat_ws(",", "extra"))
    gaps = gaps.groupBy(w).agg(F.count("*").alias("incomplete_snapshot"), F.min_by(text, "effective_date").alias("gap"))
    totals = totals.where("scale = 'unrecognized'").groupBy(w).agg(F.count("*").alias("bad_total"), F.min(F.struct("effective_date", "index_ticker")).alias("total"))
    table = windows.join(flags, w, "left").join(keys, w, "left").join(gaps, w, "left").join(totals, w, "left")
    table = table.withColumn("empty_window", (F.coalesce("rows", F.lit(0)) == 0) & covers_month_end(c("start_date"), c("end_date"))).orderBy(w).collect()
    counts = {r[w]: r["rows"] or 0 for r in table}
    for row in table:
        for rule in LADDER:
            if row[rule]:
                detail = {"unknown_ticker": row["ticker"], "incomplete_snapshot": row["gap"], "bad_total": row["total"] and f"{row['total'][0]} {row['total'][1]}"}.get(rule)
                return Failure(row[w], rule, detail), counts
    return None, counts
