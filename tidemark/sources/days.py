"""Tables partitioned by year, month and day: written by day, replaced or skipped by day, published as a whole."""

from __future__ import annotations

import heapq
import uuid
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import path_parts
from ..schemas import Table, unused
from . import files, snapshots
from .compiled import compiled

PARTS = ("year", "month")
RUN = "run"
ROWS_PER_TASK = 500_000


def keys_of(table: Table) -> tuple[str, ...]:
    """Partition columns that make up a day's key: the day, and what the table is split by besides."""
    return (table.date, *(f"part_{c}" for c in table.split))


def read_days(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """The stored table as of its newest snapshot, partition columns with their own types (months keep their zero); empty if nothing is stored.

    Day and run are partition columns, so the snapshot is a filter on folders: files that no
    snapshot names are not opened. A table without a log is read as it lies."""
    fields = [f for f in table.schema if f.name != table.date]
    key = [T.StructField(table.date, T.DateType()), *(T.StructField(k, T.StringType()) for k in keys_of(table)[1:])]
    schema = T.StructType([*fields, *(T.StructField(p, T.StringType()) for p in PARTS), *key])
    now = snapshots.current(spark, root)
    empty = spark.createDataFrame([], schema)
    if now is not None:
        if not now.days:
            return empty
        stored = spark.read.schema(T.StructType([*schema, T.StructField(RUN, T.StringType())])).parquet(root)
        own = F.concat_ws("/", *(F.col(k).cast("string") for k in keys_of(table)), F.col(RUN))
        return stored.where(own.isin(now.tokens())).drop(RUN)
    return spark.read.schema(schema).parquet(root) if files.names(spark, root) else empty


def stored_days(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """Distinct stored days as trade_date, with what the table is split by; from the snapshot log alone, or without one from partition values."""
    now = snapshots.current(spark, root)
    if now is None:
        return read_days(spark, root, table).select(F.col(table.date).alias("trade_date"), *(F.col(f"part_{c}").alias(c) for c in table.split)).distinct()
    rows = [(date.fromisoformat(k[0]), *k[1:]) for k in now.days]
    return spark.createDataFrame(rows, ", ".join(["trade_date date", *(f"{c} string" for c in table.split)]))


def day_counts(df: DataFrame, table: Table) -> dict[tuple[str, ...], int]:
    """Rows of each day (and part): a row per day comes to the driver."""
    counts = df.where(F.col(table.date).isNotNull()).groupBy(table.date, *table.split).agg(F.count("*").alias("n rows"))
    return {tuple(r)[:-1]: r[-1] for r in counts.select(F.col(table.date).cast("string"), *table.split, "n rows").collect()}


def packed(rows: dict[tuple[str, ...], int], tasks: int) -> list[tuple[str, int]]:
    """Each day (and part) with its task: the largest first, each to the task with the fewest rows so far."""
    load = [(0, t) for t in range(tasks)]
    out = []
    for key, n in sorted(rows.items(), key=lambda r: (-r[1], r[0])):
        held, task = heapq.heappop(load)
        heapq.heappush(load, (held + n, task))
        out.append(("/".join(key), task))
    return out


def _write(rows: DataFrame, root: str, table: Table, run: str) -> None:
    # Partition values are added to rows that are in their task already, so they are not shuffled.
    year, month = path_parts(F.col(table.date))
    rows = rows.withColumns({"year": year, "month": month, RUN: F.lit(run), **{f"part_{c}": F.col(c) for c in table.split}})
    parts = (*PARTS, *keys_of(table))
    order = [*parts, *(F.asc_nulls_last(c) for c in table.order if c != table.date)]
    writer = rows.sortWithinPartitions(*order).write.mode("append").partitionBy(*parts, RUN).option("compression", "zstd")
    # Tasks put their files in place themselves: nothing is visible before the log is, and a repeated task replaces its own files.
    with compiled(rows.sparkSession):
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(root)


def write_days(df: DataFrame, root: str, table: Table, mode: str = "replace", rows_per_file: int = 5_000_000) -> list[tuple]:
    """Writes every day of df and returns (day, rows, written) of each, with what the table is split by after the day.

    replace: a stored day is replaced, other days stay. skip: stored days are left alone. Rows
    without a day, or without a value of the split, are left out. A day is one file, sorted by the
    table's order (nulls last); days are dealt to tasks by their counts, so that none gets several
    large ones by chance. A day of more than rows_per_file rows is cut at
    quantiles of the order (a range partitioning), so its files don't overlap in it. Files go to
    folders of this run; the snapshot log, published last, makes all of them visible at once.

    df is read twice, for the counts and for the files: give a staged or stored table."""
    if mode not in ("replace", "skip"):
        raise ValueError(mode)
    spark = df.sparkSession
    before = snapshots.current(spark, root) or snapshots.Snapshot(0, adopted(spark, root, table))
    df = df.where(F.col(table.date).isNotNull())
    for c in table.split:
        df = df.where(F.col(c).isNotNull())
    counts = day_counts(df, table)
    done = set(before.days) & set(counts) if mode == "skip" else set()
    todo = {k: n for k, n in counts.items() if k not in done}
    if todo:
        run = f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
        own = F.concat_ws("/", F.col(table.date).cast("string"), *table.split)
        large = {k: n for k, n in todo.items() if n > rows_per_file}
        small = {k: n for k, n in todo.items() if k not in large}
        if small:
            # Tasks by what there is to write: in few of them large sorts would spill and many files be written one after another.
            tasks = min(len(small), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(small.values()) // ROWS_PER_TASK)))
            key, task = unused("key", df.columns), unused("task", df.columns)
            places = F.broadcast(spark.createDataFrame(packed(small, tasks), f"{key} string, {task} int"))  # a row per day
            _write(df.withColumn(key, own).join(places, key).drop(key).repartitionById(tasks, F.col(task)).drop(task), root, table, run)
        if large:
            cuts: list[Column] = [*(F.col(c) for c in (table.date, *table.split)), *(F.asc_nulls_last(c) for c in table.order if c != table.date), F.xxhash64(*df.columns)]
            among = own.isin(["/".join(k) for k in large])
            _write(df.where(among).repartitionByRange(sum(-(-n // rows_per_file) for n in large.values()), *cuts), root, table, run)
        snapshots.publish(spark, root, before, run, todo)
        snapshots.forget(spark, root, keys_of(table))
    return sorted((*k, n, k not in done) for k, n in counts.items())


def adopted(spark: SparkSession, root: str, table: Table) -> dict[tuple[str, ...], tuple[str, int]]:
    """A table that was stored without a log can't be continued: its days have no run."""
    if any(n.startswith("year=") for n in files.names(spark, root)) and not read_days(spark, root, table).isEmpty():
        raise ValueError(f"{root} holds days without a snapshot log; copy them with write_days(read_days(...)) to a new root")
    return {}
