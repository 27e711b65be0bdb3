"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def roots(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """The smallest member of each node's component; nodes are 0 to size - 1."""
    parent = np.arange(size)
    while True:
        a, b = parent[u], parent[v]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: each node with its smallest reachable node."""
    pairs = [(b["u"].to_numpy(zero_copy_only=False), b["v"].to_numpy(zero_copy_only=False)) for b in batches]
    if pairs:
        u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(at[: len(u)], at[len(u) :], len(nodes))
        own = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])


def star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of each node link to its smallest neighbour; small star: the others do.

    The least neighbours are saved first, so that Spark can split the join at nodes of many links."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = both.where("v > u" if large else "true").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns id and component (smallest id reachable) for every id with a link to another.

    links: columns u and v, either way round, repeats and self links allowed; null ends are left out."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    links = saved(saved(links).mapInArrow(forest, links.schema))
    mark = (F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007))
    before = None
    while (now := tuple(links.agg(*mark).first())) != before and now[0]:
        before = now
        links = saved(star(star(links, True), False))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
