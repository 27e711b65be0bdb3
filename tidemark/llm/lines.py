"""Line dedup: lines that spread over many sites, by HyperLogLog sketches of their sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.search import rank_in
from .shared import saved, unused

BLANKS = " \t\x0b\x0c\r"
LG_K = 12
SHORT, MOST_LINES = 64, (1 << 28) - 1  # a text has at most 2**31 bytes, and a line that is judged several


def line_key(line: Column, shortest: int) -> Column:
    """Hash of a line without outer blanks; null for lines too short to judge."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(trimmed) >= shortest, F.xxhash64(trimmed))


def listed(gone: Column, key: Column) -> Column:
    """Whether a sorted list holds the key: short lists are read through, long ones halved."""
    found = F.get(gone, rank_in(gone, MOST_LINES, key) - 1) == key
    return F.coalesce(F.when(F.size(gone) <= SHORT, F.array_contains(gone, key)).otherwise(found), F.lit(False))


def spread_lines(lines: DataFrame, sites: int) -> DataFrame:
    """Keys of the lines found on `sites` distinct sites or more, and the smallest id that has each.

    Sketches of 2**12 registers err by 1.6 percent (one sigma); estimates within a
    fifth of the threshold, over ten sigma, are counted exactly. Both ways combine
    on the map side, so a line of a third of all rows is no hot key."""
    site = F.when(F.col("site").isNotNull(), F.xxhash64("site"))  # sketches leave nulls out, and would leave out empty texts
    sketch = lines.groupBy("line").agg(F.hll_sketch_agg(site, LG_K).alias("sketch"), F.min("id").alias("first"))
    guess = saved(sketch.select("line", "first", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("n")).where(F.col("n") >= 0.8 * sites))
    near = guess.where(F.col("n") < 1.2 * sites).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("exact"))
    return guess.join(exact, "line", "left").where(F.coalesce("exact", "n") >= sites).select("line", "first")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = 8, shortest: int = 10) -> DataFrame:
    """Removes boilerplate: lines of at least `shortest` characters on at least `sites` distinct sites.

    The document with the smallest id that has the line keeps it, so no content is lost
    where whole documents were copied to many sites. Lines are split at \\n and compared
    without outer blanks; blank and short lines always stay. Returns all columns, with
    the text shortened, and n_lines and n_removed. Null text: kept, both counts 0; null
    sites count for nothing, an empty one is a site; repeated rows are one document; a null
    id never is the first. Columns n_lines and n_removed are replaced, others kept whatever
    their names. Texts may be of any length. Equal lines are told by 64-bit hashes.

    Plan: a table of line hashes (no text), sketches by line hash, an exact count for the few lines near the threshold,
    then each document meets the sorted list of its own removed lines by id, or, without an id, by its text."""
    keys = F.array_compact(F.transform(F.split(text_col, "\n"), lambda x: line_key(x, shortest)))
    copy = F.when(F.col(id_col).isNull(), F.xxhash64(text_col))  # rows without an id lose what their own text has
    own = saved(docs.select(F.col(id_col).alias("id"), copy.alias("copy"), F.col(site_col).alias("site"), F.explode(F.array_distinct(keys)).alias("line")))
    held = saved(spread_lines(own, sites))
    key, same, gone, left, hashes = (unused(c, docs.columns) for c in ("key", "same", "gone", "left", "hashes"))
    lost = own.join(held, "line").where(~F.col("id").eqNullSafe(F.col("first")))
    lost = lost.groupBy(F.col("id").alias(key), F.col("copy").alias(same)).agg(F.sort_array(F.collect_set("line")).alias(gone))
    out = docs.join(lost, F.col(id_col).eqNullSafe(F.col(key)) & copy.eqNullSafe(F.col(same)), "left").drop(key, same)
    lines = F.split(text_col, "\n")
    out = out.withColumn(hashes, F.when(F.col(gone).isNotNull(), F.transform(lines, lambda x: line_key(x, shortest))))
    stay = F.filter(lines, lambda x, k: ~listed(F.col(gone), F.get(F.col(hashes), k)))
    out = out.withColumn(left, F.when(F.col(gone).isNotNull(), stay))
    count = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out = out.withColumn("n_lines", count)
    out = out.withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size(left), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).drop(left, gone, hashes)
