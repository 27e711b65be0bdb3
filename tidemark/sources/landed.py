"""Scans of landed raw tables, in Parquet, CSV or JSON."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import date_or_null
from ..functions.search import rank_in
from ..schemas import Table
from . import files

CALENDAR = "calendarDate string, isOpen int"
MOST_LITERALS = 10


def scan(spark: SparkSession, path: str | list[str], table: Table, fmt: str = "parquet", where: Column | None = None) -> DataFrame:
    """Only the table's raw fields, with the filter next to the scan so that it is pushed down.

    CSV and JSON are read as text, so a ticker keeps its leading zeros; Parquet keeps its own types."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    elif fmt == "json":
        reader = reader.schema(table.raw_schema).option("primitivesAsString", True)
    df = reader.load(path)
    df = df if where is None else df.where(where)
    return df.select(*(c for c in table.rename if c in df.columns))


@dataclass(frozen=True)
class Landed:
    """A landed table with an index of its files: batches below path, and the first day, last day, rows and undated rows of each file.

    The index, below _index, has a row per file; the lander keeps it. A scan of some days opens the
    files whose days overlap with them, and those with dates that can't be read."""

    spark: SparkSession
    path: str
    table: Table
    fmt: str = "parquet"

    def index(self) -> DataFrame:
        schema = "file string, first_day date, last_day date, n_rows bigint, n_undated bigint"
        found = files.names(self.spark, f"{self.path}/_index")
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/_index/{n}" for n in found)) if found else self.spark.createDataFrame([], schema)

    def append(self, raw: DataFrame, parts: int | None = None) -> None:
        """Lands raw rows as a batch of its own, dealt to files by ranges of days, so that each has few of them; then their index.

        A day of many rows fills several files: rows of equal days are ranged by a hash. A batch counts once its index is there."""
        source = next(a for a, b in self.table.rename.items() if b == self.table.date)
        batch = uuid.uuid4().hex
        keys = [date_or_null(F.col(source)), F.xxhash64(*raw.columns)]
        dealt = raw.repartitionByRange(*([parts] if parts else []), *keys)
        dealt.write.format(self.fmt).option("header", True).save(f"{self.path}/{batch}")
        day, name = date_or_null(F.col(source)), F.concat(F.lit(f"{batch}/"), F.col("_metadata.file_name"))
        rows = self._reader().load(f"{self.path}/{batch}").groupBy(name.alias("file"))
        index = rows.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_rows"), F.count_if(day.isNull()).alias("n_undated"))
        index.coalesce(1).write.parquet(f"{self.path}/_index/{batch}")  # a row per file

    def _reader(self):
        reader = self.spark.read.format(self.fmt)
        return reader.option("header", True).option("enforceSchema", False) if self.fmt == "csv" else reader.option("primitivesAsString", True) if self.fmt == "json" else reader

    def files(self, spans: list[tuple[date, date]]) -> list[str]:
        """Names of the files that may hold rows of the spans, each from its first to its last day."""
        if not spans:
            return []
        firsts, lasts = zip(*merged(spans), strict=True)
        # The last span that begins by the file's end must not end before the file begins.
        at = rank_in(firsts, len(firsts), F.col("last_day"))
        hit = F.get(F.array(*(F.lit(d) for d in lasts)), at - 1) >= F.col("first_day")
        return [r["file"] for r in self.index().where((F.col("n_undated") > 0) | hit).select("file").orderBy("file").collect()]  # of the asked days

    def scan(self, spans: list[tuple[date, date]]) -> DataFrame:
        """Known fields of the rows of the spans, and of rows whose date can't be read; other files are not opened."""
        found = self.files(spans)
        source = next(a for a, b in self.table.rename.items() if b == self.table.date)
        if not found:
            return self.spark.createDataFrame([], self.table.raw_schema)
        return of_days(scan(self.spark, [f"{self.path}/{f}" for f in found], self.table, self.fmt), source, spans)


def merged(spans: list[tuple[date, date]]) -> list[tuple[date, date]]:
    """Spans in order, overlapping and neighbouring ones as one."""
    out: list[tuple[date, date]] = []
    for a, b in sorted(spans):
        if out and (a - out[-1][1]).days <= 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def on_days(column: str, days: list[str]) -> Column:
    """Literal day list, which reaches the scan; good for the few days of a backfill chunk."""
    return F.col(column).isin(days)


def of_days(df: DataFrame, column: str, spans: list[tuple[date, date]]) -> DataFrame:
    """Rows of the days from first to last of any span, and rows whose date can't be read, for validation.

    A few spans are literals in the scan's filter, on text in both of its forms. Of many, the whole
    range is, and each row finds its span by binary search in an expression; no join either way."""
    if not spans:
        return df.where(F.lit(False))
    spans = merged(spans)
    day, text = date_or_null(F.col(column)), isinstance(df.schema[column].dataType, T.StringType)

    def between(a: date, b: date) -> Column:
        if not text:
            return day.between(F.lit(a), F.lit(b))
        forms = [(str(a), str(b)), (f"{a:%Y%m%d}", f"{b:%Y%m%d}")]
        return reduce(Column.__or__, (F.col(column).between(x, y) if a < b else F.col(column) == x for x, y in forms))

    few = len(spans) <= MOST_LITERALS
    if isinstance(df.schema[column].dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
        firsts, lasts = zip(*spans, strict=True)
        within = lambda d: reduce(Column.__or__, (d.between(F.lit(a), F.lit(b)) for a, b in spans)) if few else d <= F.get(F.array(*(F.lit(b) for b in lasts)), rank_in(firsts, len(firsts), d) - 1)
        # The column stands here once: what stands twice is computed ahead of the frame's own conditions, also on rows that they leave out.
        return df.where(F.exists(F.array(F.col(column).cast("date")), lambda d: d.isNull() | within(d)))
    pushed = reduce(Column.__or__, (between(a, b) for a, b in (spans if few else [(spans[0][0], spans[-1][1])])))
    if few and not text:
        return df.where(day.isNull() | pushed)
    firsts, lasts = zip(*spans, strict=True)
    last = F.get(F.array(*(F.lit(b) for b in lasts)), rank_in(firsts, len(firsts), day) - 1)
    return df.where(day.isNull() | (pushed & (day <= last)))


def in_range(column: str, start: str, end: str) -> Column:
    return F.col(column).between(start, end)


def of_tickers(df: DataFrame, catalog: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Rows of the catalog's tickers: a broadcast semi-join."""
    wanted = F.broadcast(catalog.select(F.col("catalog_ticker").alias("wanted")).distinct())
    return df.alias("rows").join(wanted.alias("known"), F.col(f"rows.{ticker}").cast("string") == F.col("known.wanted"), "left_semi")


def calendar(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """calendar_date DATE and is_open INT of a landed trading calendar."""
    return spark.read.schema(CALENDAR).format(fmt).load(path).select(date_or_null(F.col("calendarDate")).alias("calendar_date"), F.col("isOpen").alias("is_open"))


def empty(spark: SparkSession, table: Table) -> DataFrame:
    """No rows, with the processed columns."""
    return spark.createDataFrame([], table.schema)


def union(frames: list[DataFrame], spark: SparkSession, table: Table) -> DataFrame:
    """All rows of all batches; no batch gives the typed empty table."""
    if not frames:
        return empty(spark, table)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
