"""A working folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def working_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base}/tables/{uuid.uuid4().hex}"
