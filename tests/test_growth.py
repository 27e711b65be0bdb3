"""What keeps the ingest queries in proportion to their tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import coerce
from tidemark.schemas import Table
from tidemark.sources import days
from tidemark.sources.compiled import LIMIT

SMALL = "/root/testdata/sf0.001"
PLAIN = Table("plain", {}, "id bigint, day date", "day", ("id",))


def test_rows_are_dealt_for_landing_while_narrow(spark, monkeypatch):
    """Bars have twenty fields; what they are made of has ten columns, and goes by a key, not in turn."""
    frame, seen = type(spark.range(0)), []
    before = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: seen.append((len(self.columns), len(a))) or before(self, *a))
    assert queries.equity_scan(spark, SMALL).count() > 0 and queries.index_scan(spark, SMALL).count() > 0
    assert seen and all(width <= 10 and given > 1 for width, given in seen)


def test_days_go_to_tasks_by_their_rows(spark, tmp_path, monkeypatch):
    """Forty days of ten rows, ten rows a task: forty tasks, whatever their hashes and the session's partitions."""
    monkeypatch.setattr(days, "ROWS_PER_TASK", 10)
    rows = spark.range(400).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"))
    assert days.write_days(rows, str(tmp_path / "d"), PLAIN)[0][1] == 10
    tasks = [re.match(r"part-(\d+)", f.name)[1] for f in (tmp_path / "d").rglob("part-*.parquet")]
    assert len(tasks) == len(set(tasks)) == 40
    assert sorted(r["id"] for r in days.read_days(spark, str(tmp_path / "d"), PLAIN).collect()) == list(range(400))


def test_packed_days():
    found = days.packed({("a",): 5, ("b", "X"): 4, ("c",): 3, ("d",): 2}, 2)
    assert dict(found) == {"a": 0, "b/X": 1, "c": 1, "d": 0}


def test_order_is_judged_without_paths(spark, monkeypatch):
    """What the window holds of a row's file is its name."""
    seen = []
    frame = type(spark.range(0))
    before = frame.withColumns
    monkeypatch.setattr(frame, "withColumns", lambda self, columns: seen.append(before(self, columns)) or seen[-1])
    assert queries.weights_order(spark, SMALL).agg(F.sum("n_late")).first()[0] == 0
    files = next(df for df in seen if "file" in df.columns).select("file").distinct().collect()
    assert files and all("/" not in r["file"] for r in files)


def test_numbers_long_and_short(spark):
    """Plain numbers go past the test of size; three hundred digits and more, and exponents, do not."""
    texts = {"1": 1.0, " -2.50 ": -2.5, "+.5": 0.5, "3.": 3.0, "9" * 300: 1e300, "9" * 301: 1e301, "9" * 400: None, "1e999": None, "1e3": 1000.0, "1d": None, "1.2.3": None, ".": None, "": None, "0x1p3": None, "nan": None, "--": None, "-inf": float("-inf")}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", coerce.number_or_null(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == texts


def test_days_are_written_by_compiled_code(spark, tmp_path, monkeypatch):
    seen, before, limit = [], DataFrameWriter.parquet, spark.conf.get(LIMIT)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: seen.append(spark.conf.get(LIMIT)) or before(self, *a, **b))
    days.write_days(spark.sql("select 1L id, date'2024-01-01' day"), str(tmp_path / "d"), PLAIN)
    assert seen == ["8000"] and spark.conf.get(LIMIT) == limit
