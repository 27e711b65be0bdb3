"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.search import rank_in
from . import repeats, text
from .shared import saved

BLOCK_BYTES, KNOTS = 4 << 20, 1000
LAST = np.iinfo(np.int64).max


def in_order(docs: DataFrame) -> DataFrame:
    """Adds place, a number that grows with the id, and block, which is one place or, where all
    rows have the same id or none, a part of one. Blocks have about BLOCK_BYTES of text.

    Up to 1,000 quantiles of the id cut ranges; an id that is several quantiles has a range of
    its own. Bytes of a range, some thousand numbers, tell into how many even parts of its ids
    it is cut. Quantiles are approximate, but ids are compared with them, and divided, as whole
    numbers (BIGINT), so the order holds for ids of any size. Null ids come last. Rows of one id
    that fill several blocks are dealt by their number in a saved copy, which no retry changes."""
    number = F.col("id").cast("long")
    quantiles = docs.agg(F.percentile_approx(number, [i / KNOTS for i in range(KNOTS)], 10 * KNOTS)).first()[0] or []
    often = {a for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b}
    knots = sorted({int(k) for k in quantiles} | {min(int(k) + 1, LAST) for k in often})
    ranged = lambda rows: rows.withColumn("range", F.coalesce(rank_in(knots, len(knots), number), F.lit(len(knots) + 1)))
    sizes = {r["range"]: r for r in ranged(docs).groupBy("range").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(number).alias("lo"), F.max(number).alias("hi")).collect()}
    each = repeats.block_bytes(sum(r["bytes"] or 0 for r in sizes.values()), BLOCK_BYTES, docs)
    base, held, columns = 0, 0, []
    for k in range(len(knots) + 2):  # small neighbours are one block, large ranges are cut
        r = sizes.get(k)
        size, low, high = (r["bytes"] or 0, r["lo"] or 0, r["hi"] or 0) if r else (0, 0, 0)
        parts = max(1, -(-size // each))
        if held and (held + size > each or k > len(knots)):  # rows without an id stay apart
            base, held = base + 1, 0
        columns.append((base, parts, low, high))
        held += size + 1
        if parts > 1:
            base, held = base + parts, 0
    out = docs.withColumn("row", F.lit(0).cast("long"))
    if any(parts > 1 and low == high for _, parts, low, high in columns):
        out = saved(docs.withColumn("row", F.monotonically_increasing_id()))
    at = lambda k: F.get(F.array(*(F.lit(c[k]) for c in columns)).cast("array<bigint>"), F.col("range"))
    out = ranged(out).withColumns({"base": at(0), "parts": at(1), "lo": at(2), "hi": at(3)})
    same = F.col("hi") == F.col("lo")
    wide = "decimal(20,0)"  # differences of BIGINTs
    cut = F.expr(f"((cast(id as bigint) - cast(lo as {wide})) * parts) div (cast(hi as {wide}) - lo + 1)")
    out = out.withColumn("block", F.col("base") + F.when(F.col("parts") == 1, F.lit(0)).when(same, F.pmod("row", "parts")).otherwise(cut))
    return out.select(*docs.columns, "block", F.when(same, F.col("base")).otherwise(F.col("block")).alias("place"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """Removes every word covered by a window of width words that a document with a smaller id also has.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Windows are judged on the input, not on
    what is left, and never cross documents. Returns the id, text (kept words joined
    by one space), n_words, n_removed and spans (maximal removed runs of words, end
    exclusive). A null or empty text gives empty results; documents with fewer than
    width words keep all; rows with equal ids (repeated rows) are not copies of each
    other; a null id counts as larger than any other. Other columns are ignored.
    Equal windows are told by 64-bit hashes.

    Plan: one shuffle of the texts into id ranges, one of the distinct window hashes
    of each range (about 6 bytes each), one of the answers (a bit each).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks, buckets = in_order(docs), repeats.buckets_of(docs)

    def hashes(table: pa.Table):
        data, offsets = text.utf8(table["text"])
        starts, ends, first, own = text.words(data, offsets)
        return data, offsets, starts, ends, first, *text.window_hashes(own, first, width)

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")]))
        data, offsets, starts, ends, first, at, windows = hashes(table)
        ids = pc.fill_null(table["id"].cast(pa.int64()), LAST).to_numpy()
        found = repeats.flags(windows, replies, "before")
        owner = ids[np.searchsorted(first, at, "right") - 1]
        order = np.argsort(windows, kind="stable")  # windows stand in id order
        ordered = windows[order]
        head = np.ones(len(order), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        smallest = owner[order][np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else owner
        found[order] |= owner[order] > smallest
        gone = text.spread(at[found], width, len(starts))
        removed = np.concatenate([[0], np.cumsum(gone)])
        keep = np.zeros(len(data) + 1, np.int8)
        stay = ~gone
        keep[starts[stay]] += 1
        keep[ends[stay]] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
        row = np.searchsorted(first, np.flatnonzero(stay), "right")
        gap = ends[stay][:-1][row[1:] == row[:-1]]  # after each kept word but a row's last
        data = data.copy()
        data[gap], keep[gap] = 0x20, True
        return pa.table({
            "id": table["id"], "text": text.masked(data, offsets, keep), "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(np.diff(removed[first]), pa.int64()), "spans": text.span_lists(*text_runs(gone, first)),
        })

    def text_runs(gone: np.ndarray, first: np.ndarray):
        starts, ends, rows = text.runs(gone, first)
        base = np.repeat(first[:-1], np.diff(rows))
        return starts - base, ends - base, rows

    keys = repeats.send(blocks, lambda table: np.unique(hashes(table)[-1]), buckets)
    replies = repeats.answers(keys, earlier=True)
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(remove, schema)
    return out.withColumnRenamed("id", id_col)
