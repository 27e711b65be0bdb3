"""One document per run: a head and its quality records."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import scale_counts

# The fields of the run's document.
WINDOW = "struct<classification_version:string,start_date:string,end_date:string>"
HEAD = (
    "status string, source_api string, created_at_utc timestamp, parameters struct<start_date:string,end_date:string,output_root:string,overwrite:boolean>, "
    "calls array<struct<classification_version:string,start_date:string,end_date:string,tickers:array<string>,status:string,rows:bigint,error_type:string>>, "
    f"completed_windows array<{WINDOW}>, files struct<written:array<struct<path:string,effective_date:string,rows:bigint>>,skipped:array<struct<path:string,effective_date:string,rows:bigint>>>, "
    "summary struct<api_calls:bigint,rows_downloaded:bigint,files_written:bigint,files_skipped:bigint,unique_index_tickers:bigint,unique_effective_dates:bigint,rows_outside:bigint>, "
    f"failure struct<error_type:string,window:{WINDOW}>"
)
TOTALS = "classification_version string, index_ticker string, effective_date date, weight_total double, scale string"
COUNTS = "quality struct<weight_scale_counts:map<string,bigint>>"


def manifest(spark: SparkSession, head: dict[str, Any], totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The head of the document, one row with the counts of scales, and its quality records: a row for each group of totals."""
    counts = {r["scale"]: r["n"] for r in scale_counts(totals).collect()}  # three scales
    row = head | {"created_at_utc": datetime.now(UTC), "quality": {"weight_scale_counts": dict(sorted(counts.items()))}}
    return spark.createDataFrame([row], f"{HEAD}, {COUNTS}"), totals.select(*(n.split()[0] for n in TOTALS.split(", ")))


def write_manifest(row: DataFrame, totals: DataFrame, root: str) -> str:
    """Writes _manifests/run=<time> under root (the underscore hides it from scans of the table) and returns its path.

    Quality records are rows beside the head, in as many files as they need, below `_quality`; the head, which makes the run count, comes last."""
    path = f"{root}/_manifests/run={datetime.now(UTC):%Y%m%dT%H%M%S%fZ}"
    totals.write.option("ignoreNullFields", False).json(f"{path}/_quality")
    row.coalesce(1).write.mode("append").option("ignoreNullFields", False).json(path)
    return path


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """The heads of all documents under a table's root, one row per run, with the run's folder as `run_path`."""
    heads = spark.read.schema(f"{HEAD}, {COUNTS}").json(f"{root}/_manifests/*")
    return heads.withColumn("run_path", F.regexp_extract(F.input_file_name(), "_manifests/(run=[^/]+)", 1))


def read_quality(spark: SparkSession, root: str) -> DataFrame:
    """The quality records of all documents under a table's root, a row for each group, with the run's folder as `run_path`."""
    rows = spark.read.schema(TOTALS).json(f"{root}/_manifests/*/_quality")
    return rows.withColumn("run_path", F.regexp_extract(F.input_file_name(), "_manifests/(run=[^/]+)", 1))
