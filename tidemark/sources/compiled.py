"""Generated code in pieces that the JVM compiles."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled(spark: SparkSession):
    """For a job over some twenty coerced columns, which make one method of generated code that is too long
    for the JVM to compile (8,000 bytes), so it would be interpreted; within the limit Spark splits it up."""
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "8000")
        yield
    finally:
        spark.conf.set(LIMIT, before)
