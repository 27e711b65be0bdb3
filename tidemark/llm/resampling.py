"""Importance resampling towards a target corpus: array-scored weights, then a distributed LSD radix sort."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .shared import saved
from .sums import added

BUCKETS, MOST_WORDS, SHORT, DIGIT_BITS, BLOCK_ROWS = 10_000, 3, 48, 16, 1 << 18
#: Words are digits, small letters and all bytes beyond ASCII.
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def crc_table() -> np.ndarray:
    """The register's change by each byte."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> np.uint32(1)) ^ np.where(state & 1, np.uint32(0xEDB88320), np.uint32(0))
    return state


TABLE = crc_table()


def carried(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each span, all spans a byte at a time; a long span's rest goes by itself."""
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.int16), kind="stable")[::-1]
    at, register = starts[order], state[order]
    sorted_ = lengths[order]
    live = np.searchsorted(-sorted_, -np.arange(1, min(int(sorted_[0]) if len(at) else 0, SHORT) + 1), "right")
    for k, n in enumerate(live.tolist()):
        now = register[:n]
        register[:n] = TABLE[(now ^ data[at[:n] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in np.flatnonzero(sorted_ > SHORT).tolist():
        register[i] = zlib.crc32(data[at[i] + SHORT : at[i] + sorted_[i]], int(~register[i])) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = register
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, most: int = MOST_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, words of each row, and row and bucket of every feature (runs of 1 to most words)."""
    space = np.array([0x20], np.uint8)
    for a, b in text.chunks(offsets):
        part, own = text.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = text.word_spans(part, own, GAPS)
        words = np.diff(first)
        row, last = np.repeat(np.arange(b - a), words), np.repeat(first[1:], words)
        at, state = np.arange(len(starts)), np.full(len(starts), 0xFFFFFFFF, np.uint32)
        rows, found = [], []
        for n in range(most):
            if n:
                live = np.flatnonzero(at + n < last[at])
                at, state = at[live], state[live]
                state = TABLE[(state ^ space) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = carried(state, part, starts[at + n], ends[at + n])
            rows.append(row[at])
            found.append((~state % np.uint32(buckets)).astype(np.int64))
        yield a, words, np.concatenate(rows), np.concatenate(found)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in features(*text.utf8(batch["text"]), buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total], pa.list_(pa.int64()))], ["part", "v"])

    return added(texts.mapInArrow(count, "part long, v array<long>"), buckets)


def gains(target: np.ndarray, source: np.ndarray, scale: int = 1000) -> np.ndarray:
    """What a feature of each bucket adds to a weight: scaled log ratio of its smoothed shares, as a whole number."""
    size, all_target, all_source = len(target), int(target.sum()), int(source.sum())
    return np.array([math.floor(scale * math.log((t + 1) * (all_source + size) / ((s + 1) * (all_target + size)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def gumbel(seed: int, name, scale: int = 1000) -> int:
    """A draw for each id, the same in every run."""
    h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def digits_of(keys: list[tuple[str, int]], width: int = DIGIT_BITS) -> list[tuple[str, int, int]]:
    """(key, shift, bits) of each pass, least key and digit first; a key of one value needs none."""
    out = []
    for name, most in keys:
        passes = -(-most.bit_length() // width)
        each = -(-most.bit_length() // passes) if passes else 0
        out += [(name, k * each, each) for k in range(passes)]
    return out


def counting_pass(rows: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """Rows with place changed to where a stable counting sort by digit puts them.

    A block is a run of places. Its rows are numbered within each digit; the counts of all
    (block, digit) are summed up by digit over blocks, and over digits, which gives every
    block's first destination for each digit. Blocks are of one size whatever the digits are."""
    keyed = rows.withColumns({"block": F.expr(f"place div {block_rows}"), "digit": digit})
    counts = keyed.groupBy("block", "digit").agg(F.count("*").alias("n"))
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    bases = totals.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("base"))  # a row per digit, 2**16 at most
    before = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
    offsets = counts.select("block", "digit", before.alias("before")).join(F.broadcast(bases), "digit").select("block", "digit", (F.col("base") + F.col("before")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    placed = keyed.withColumn("within", within).join(offsets, ["block", "digit"])
    return placed.select(*(c for c in rows.columns if c != "place"), (F.col("offset") + F.col("within")).alias("place"))


def radix_places(rows: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS, width: int = DIGIT_BITS) -> DataFrame:
    """Rows with place, from 0, in the order of keys (the least significant first): one saved counting pass per digit.

    keys: columns of whole numbers that are not negative. rows: a saved table, with a column
    place of distinct numbers; rows equal in all keys keep its order."""
    most = rows.agg(*(F.max(k) for k in keys)).first()
    first = True
    for name, shift, bits in digits_of([(k, m or 0) for k, m in zip(keys, most, strict=True)], width) or [(keys[0], 0, 1)]:
        digit = F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit((1 << bits) - 1))
        # The first places are those of the scan: high bits are the partition, which the block is then.
        rows = saved(counting_pass(rows, digit, 1 << 33 if first else block_rows))
        first = False
    return rows


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns id, n_words, n_features, weight, score and rank, one row per document.

    A feature is a run of one to three words, by the CRC-32 of its bytes in one of the buckets;
    a bucket's gain is the scaled log ratio of its smoothed share in target and in docs. weight
    is the sum of a document's gains, score adds a Gumbel draw by seed and id, and of the N
    documents with at least least_words words the floor(percent * N / 100) highest scores have
    ranks 1, 2, 3...; others have none. That draws without replacement, in proportion to the
    exponential of weight / 1000.

    Ties go to the smaller id; a null id is the largest and draws as an empty text; rows equal in
    id and score keep the order in which they were read. Null and empty texts have no word, no
    feature and weight 0. An empty target or an empty table of documents is fine. Ids are whole
    numbers. Other columns are ignored.

    Plan: a narrow pass counts features in arrays of `buckets` numbers, a second one scores; both
    compute the same hashes, which is cheaper than storing them. Only ids and numbers are sorted:
    a shuffle and a saved table for each digit of 16 bits of the keys.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(target.select(F.col(target_col).alias("text")), buckets), bucket_counts(docs.select("text"), buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((3, len(batch)), np.int64)
            for a, words, rows, found in features(*text.utf8(batch["text"]), buckets):
                b = a + len(words)
                counts[0, a:b], counts[1, a:b] = words, np.bincount(rows, minlength=len(words))
                counts[2, a:b] = np.bincount(rows, gain[found], len(words))  # whole numbers, far below 2**53
            draw = np.array([gumbel(seed, x) for x in batch["id"].to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c) for c in counts), pa.array(counts[2] + draw)], ["id", "n_words", "n_features", "weight", "score"])

    scored = saved(docs.mapInArrow(score, f"id {dict(docs.dtypes)['id']}, n_words long, n_features long, weight long, score long"))
    able = F.col("n_words") >= least_words
    count, low, high = scored.where(able).agg(F.count("*"), F.min(F.shiftright(F.col("id").cast("long"), 32)), F.max("score")).first()
    number = F.col("id").cast("long")
    keyed = scored.where(able).withColumns({
        "low": F.coalesce(number.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0)), "high": F.coalesce(F.shiftright(number, 32) - F.lit(low or 0), F.lit(0)).cast("long"),
        "unknown": number.isNull().cast("long"), "down": F.lit(high or 0) - F.col("score"), "place": F.monotonically_increasing_id(),
    })
    ranked = radix_places(saved(keyed), ["low", "high", "unknown", "down"], block_rows)
    columns = ("id", "n_words", "n_features", "weight", "score")
    drawn = F.when(F.col("place") < F.lit(percent * count // 100), F.col("place") + 1)
    out = ranked.select(*columns, drawn.alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
    return out.withColumnRenamed("id", id_col)
