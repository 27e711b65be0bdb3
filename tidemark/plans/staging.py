"""One pass over a raw scan: rows go to a stage, and counts are observed by the job that writes them."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import files
from ..sources.compiled import compiled
from ..sources.folders import working_folder


@dataclass
class Watch:
    """Metrics of a frame's rows, known once the stage is written."""

    seen: list[Observation] = field(default_factory=list)

    def rows(self, df: DataFrame, rules: dict[str, Column], **more: Column) -> DataFrame:
        """Counts the rows on which each rule is true, and more aggregates, where this frame is in the plan."""
        own = Observation()
        self.seen.append(own)
        return df.observe(own, *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()), *(c.alias(n) for n, c in more.items()))

    def found(self) -> dict[str, Any]:
        return {k: v for own in self.seen for k, v in own.get.items()}


@contextmanager
def staged(df: DataFrame):
    """The rows of df, written once to a working folder and read from there; the folder goes at the end, whatever happens."""
    spark = df.sparkSession
    path = working_folder(spark)
    try:
        with compiled(spark):
            df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        files.remove(spark, path)
