"""Which 64-bit keys occur again elsewhere in a corpus, counted in Spark.

Documents are dealt into blocks of a few megabytes. A block sends its sorted distinct
keys, those it has twice two times, as one array for each hash range (bucket) in which
it has any, so there are never more rows than keys. Spark deals the arrays by bucket,
takes them apart and counts every key; what occurs again goes back to its blocks. A key
that fills a third of the corpus is two rows of a block at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U64 = np.uint64
KEYS = "bucket int, block long, place long, keys array<long>"
BUCKETS = 4


def buckets_of(df: DataFrame) -> int:
    """Hash ranges: some for each shuffle partition, so that partitions come out even."""
    return BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_bytes(total: int, most: int, df: DataFrame) -> int:
    """Bytes of a block: as many blocks as shuffle partitions, but neither over `most` nor under a quarter of it."""
    return max(1, min(most, max(most // 4, total // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def key_rows(block: int, place: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket with keys; a key that occurs more than once stands there twice."""
    keys = np.sort(keys)
    keep = np.ones(len(keys), bool)
    keep[2:] = keys[2:] != keys[:-2]
    keys = keys[keep]
    bucket = (keys >> U64(32)) * U64(buckets) >> U64(32)
    heads = np.flatnonzero(np.diff(bucket, prepend=np.array([buckets], U64)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(keys)), pa.int32()), pa.array(keys.view(np.int64)))
    same = [pa.array(np.full(len(heads), x, np.int64)) for x in (block, place)]
    return pa.table([pa.array(bucket[heads].astype(np.int32)), *same, lists], ["bucket", "block", "place", "keys"])


def answers(keys: DataFrame, earlier: bool = False) -> DataFrame:
    """For each block, by bucket, its keys that occur again: in array before those that a smaller
    place has too, in array here the others. earlier: only the former are wanted."""
    same = Window.partitionBy("bucket", "key")
    rows = keys.repartition("bucket").select("bucket", "block", "place", F.explode("keys").alias("key"))
    rows = rows.select("bucket", "block", "key", F.count("*").over(same).alias("n"), (F.col("place") > F.min("place").over(same)).alias("before"))
    rows = rows.where("before" if earlier else "n > 1")
    before, here = (F.collect_list(F.when(c, F.col("key"))) for c in (F.col("before"), ~F.col("before")))
    return rows.groupBy("bucket", "block").agg(before.alias("before"), here.alias("here")).drop("bucket")


def flags(keys: np.ndarray, replies: pa.Table, *columns: str) -> np.ndarray:
    """Which of a block's keys are in the arrays that came back."""
    found = np.unique(np.concatenate([np.zeros(0, np.int64), *(replies[c].combine_chunks().flatten().to_numpy() for c in columns)]).view(U64))
    if not len(found):
        return np.zeros(len(keys), bool)
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys


def send(blocks: DataFrame, make: Callable[[pa.Table], np.ndarray], buckets: int) -> DataFrame:
    """The keys of every block. make: documents of a block (with columns block and place) to its keys."""

    def run(table: pa.Table) -> pa.Table:
        return key_rows(table["block"][0].as_py(), table["place"][0].as_py(), make(table), buckets)

    return blocks.groupBy("block").applyInArrow(run, KEYS)


def send_again(blocks: DataFrame, replies: DataFrame, make: Callable[[pa.Table, pa.Table], np.ndarray], buckets: int) -> DataFrame:
    """Keys of a further level, which depend on the answers so far."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        return key_rows(docs["block"][0].as_py(), docs["place"][0].as_py(), make(docs, found), buckets)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, KEYS)
