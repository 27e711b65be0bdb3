"""Sums of one array per partition, in two levels of Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS, SLICE = 1024, 8192


def added(parts: DataFrame, size: int, groups: int = GROUPS) -> np.ndarray:
    """Elementwise sum of the arrays of all rows; zeros of no rows.

    parts: a column part (a number of the partition) and v, an array of size numbers. Arrays go
    in slices; a task of the first level adds the slices of some parts, one of the second at most
    `groups` of them, and one array comes to the driver."""
    kind = dict(parts.dtypes)["v"]
    schema = f"k int, part long, v {kind}"

    def add(table: pa.Table) -> pa.Table:
        column = table["v"].combine_chunks()
        total = column.flatten().to_numpy().reshape(len(column), -1).sum(0)
        return pa.table({"k": table["k"][:1], "part": table["part"][:1], "v": pa.array([total], column.type)})

    starts = F.sequence(F.lit(0), F.lit((size - 1) // SLICE)) if size else F.array().cast("array<int>")
    pieces = parts.select(F.pmod("part", F.lit(groups)).alias("part"), "v", F.explode(starts).alias("k")).select("k", "part", F.slice("v", F.col("k") * SLICE + 1, F.lit(SLICE)).alias("v"))
    first = pieces.groupBy("k", "part").applyInArrow(add, schema)
    rows = sorted(first.groupBy("k").applyInArrow(add, schema).select("k", "v").collect())
    return np.concatenate([np.asarray(r["v"]) for r in rows]) if rows else np.zeros(size, np.float64 if "double" in kind else np.int64)
