"""Suffix-array dedup: long repeated byte strings, by bucket-pointer refinement.

The suffixes that take part stand where a window's least q-gram does (its anchor), so
equal windows have equal anchors at the same distance. A suffix's q-gram names its initial
bucket. A bucket of twice the length is named by its own bucket and the bucket at a later
offset, and so on (50, 100, 200 bytes), so longer strings never are read again: the names
are updated from and reuse the shorter ones. Spark sorts the names and counts them. A
bucket of one member leaves. The others are refined, first for the whole run of windows
that share the anchor, then for cells of 13 windows, then for single windows; members that
agree over all of a run or a cell are settled and leave, but for those of one block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats, text
from .shared import saved

U64 = np.uint64
BLOCK_BYTES, CELL = 4 << 20, 13
BUCKET, RUN, CORE, SPAN, WINDOW = range(5)
SALT = [U64(0x632BE59BD9B4E019 * k & (1 << 64) - 1) for k in (1, 3, 5, 7, 9)]
ODD = U64(text.BASE)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by prefix and suffix minima of blocks."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def widths(length: int, gram: int) -> list[int]:
    """Lengths of the strings that buckets stand for: from the q-gram doubled up to half of length, then length."""
    out = [gram]
    while 2 * out[-1] < length:
        out.append(min(2 * out[-1], max(-(-length // 2), gram)))
    return [*out, *[length] * (out[-1] < length)]


def refined(own: np.ndarray, later: np.ndarray, offset) -> np.ndarray:
    """The bucket of a longer string: by the buckets of its beginning and of its end, which stands offset further on."""
    return text.mix(own * ODD + later + np.asarray(offset).astype(U64))


@dataclass
class Part:
    """Some whole documents of a block: the q-gram bucket of each position, and each anchor with its first and last window start."""

    base: int
    grams: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    widths: list[int]

    def bucket(self, at: np.ndarray, level: int) -> np.ndarray:
        """Buckets of the strings of widths[level] bytes that start there."""
        if not level:
            return self.grams[at]
        offset = self.widths[level] - self.widths[level - 1]
        return refined(self.bucket(at, level - 1), self.bucket(at + offset, level - 1), offset)

    def span(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        """Buckets of [a, b), where a string of the level's width starts at a and another ends at b."""
        later = b - self.widths[level]
        return refined(self.bucket(a, level), self.bucket(later, level), later - a)


def anchors(data: np.ndarray, offsets: np.ndarray, base: int, length: int, gram: int) -> Part:
    steps, none = widths(length, gram), np.zeros(0, np.int64)
    if len(data) < length:
        return Part(base, none.astype(U64), none, none, none, steps)
    prefix = text.prefix_hash(text.BYTE_VALUES[data])
    low = U64((1 << len(data).bit_length()) - 1)
    n = len(data) - gram + 1
    hashes = text.mix((prefix[gram:] - prefix[:-gram]) * text.Powers.upto(n)[1])
    least = sliding_min((hashes & ~low) | np.arange(n, dtype=U64), length - gram + 1)
    at = (least & low).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + length <= ends
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return Part(base, hashes, at[first], first, np.flatnonzero(stop), steps)


class Block:
    """The documents of one block, and the keys by which each level is judged."""

    def __init__(self, column, length: int, gram: int):
        self.length, self.gram = length, gram
        steps = widths(length, gram)
        self.top = len(steps) - 1
        self.cell = min(CELL, length - steps[-2] + 1) if self.top else 1  # what its windows share is a string of the level below
        self.data, self.offsets = text.utf8(column)
        self.parts = [
            anchors(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a], int(self.offsets[a]), length, gram)
            for a, b in text.chunks(self.offsets)
        ]
        self.sizes = [len(p.anchor) for p in self.parts]

    def keys(self, kind: int, buckets: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
        """Keys of one kind: a bucket, and where the anchor stands in it."""
        return np.concatenate([np.zeros(0, U64), *(refined(b, np.full(len(b), SALT[kind]), p) for b, p in zip(buckets, places, strict=True))])

    def split(self, flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        return np.split(flags, np.cumsum(sizes)[:-1]) if sizes else []

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all anchors (the initial buckets) and of their whole runs."""
        return (
            self.keys(BUCKET, [p.bucket(p.anchor, 0) for p in self.parts], [0 * p.anchor for p in self.parts]),
            self.keys(RUN, [p.span(p.first, p.last + self.length, self.top) for p in self.parts], [p.anchor - p.first for p in self.parts]),
        )

    def cells(self, open_: np.ndarray):
        """Cells of the open runs: part by part their anchors, first and last starts, and the core all windows of a full cell share."""
        out = []
        for p, mask in zip(self.parts, self.split(open_, self.sizes), strict=True):
            a, b, at = p.first[mask], p.last[mask], p.anchor[mask]
            low = (at - b) // self.cell
            count = (at - a) // self.cell - low + 1
            own = np.repeat(np.arange(len(at)), count)
            cell = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            far = at[own] - np.minimum(cell * self.cell + self.cell - 1, self.length - self.gram)
            near = at[own] - cell * self.cell
            out.append((at[own], np.maximum(a[own], far), np.minimum(b[own], near), near, far + self.length))
        return out

    def cell_keys(self, cells) -> tuple[np.ndarray, np.ndarray]:
        pairs = list(zip(self.parts, cells, strict=True))
        return (
            self.keys(CORE, [p.span(near, end, self.top - 1) for p, (_, _, _, near, end) in pairs], [at - near for at, _, _, near, _ in cells]),
            self.keys(SPAN, [p.span(a, b + self.length, self.top) for p, (_, a, b, _, _) in pairs], [at - a for at, a, *_ in cells]),
        )

    def starts(self, cells, open_: np.ndarray) -> list[np.ndarray]:
        """All window starts of the open cells."""
        out = []
        for (_, a, b, _, _), mask in zip(cells, self.split(open_, [len(c[0]) for c in cells]), strict=True):
            a, count = a[mask], (b - a + 1)[mask]
            out.append(np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum()))
        return out

    def window_keys(self, starts: list[np.ndarray]) -> np.ndarray:
        return self.keys(WINDOW, [p.bucket(s, self.top) for p, s in zip(self.parts, starts, strict=True)], [0 * s for s in starts])


def narrow(block: Block, replies: pa.Table):
    """What the first answers settle: runs found repeated, and those to look into.

    Of the members of a settled bucket, those of its first block go on for the others."""
    anchor, run = block.runs()
    whole = repeats.flags(run, replies, "before", "here")
    return whole, repeats.flags(anchor, replies, "before", "here") & ~(whole & repeats.flags(run, replies, "before"))


def narrow_again(block: Block, cells, replies: pa.Table):
    core, span = block.cell_keys(cells)
    whole = repeats.flags(span, replies, "before", "here")
    return whole, repeats.flags(core, replies, "before", "here") & ~(whole & repeats.flags(span, replies, "before"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 50, whole_characters: bool = False) -> DataFrame:
    """Removes each byte covered by a string of length bytes that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross documents; a repeat inside one document
    counts, overlapping ones too; strings are judged on the input, not on what is left.
    Returns the id, kept (binary: the remaining bytes), n_bytes, n_removed and spans
    (maximal removed runs of bytes, end exclusive). With whole_characters, a character
    that loses a byte goes altogether, so that kept is valid UTF-8. A null text counts as empty; texts
    shorter than length keep all; repeated rows are copies of each other; ids only name
    rows, so null and repeated ids are allowed. Other columns are ignored. Equal strings
    are told by 64-bit hashes.

    Plan: the texts are saved with their block, which no retry changes; one shuffle of them
    into blocks, reused by every level; per level one of
    the keys still open and one of the answers. Anchors stand every (length - gram) / 2
    bytes or so, runs and cells of repeated passages are settled by one key for all.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // repeats.block_bytes(total, BLOCK_BYTES, docs)))
    row = F.xxhash64("id", F.monotonically_increasing_id())  # rows that repeat, or have no id, are spread too
    blocks = saved(docs.withColumn("block", F.pmod(row, F.lit(count)))).withColumn("place", F.col("block"))  # saved, so that a retry finds the same blocks
    buckets = repeats.buckets_of(docs)

    def first(table: pa.Table) -> np.ndarray:
        return np.concatenate(Block(table["text"], length, gram).runs())

    def second(table: pa.Table, replies: pa.Table) -> np.ndarray:
        block = Block(table["text"], length, gram)
        return np.concatenate(block.cell_keys(block.cells(narrow(block, replies)[1])))

    def third(table: pa.Table, replies: pa.Table) -> np.ndarray:
        block = Block(table["text"], length, gram)
        cells = block.cells(narrow(block, replies)[1])
        return block.window_keys(block.starts(cells, narrow_again(block, cells, replies)[1]))

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table["text"], length, gram)
        whole, open_ = narrow(block, replies)
        cells = block.cells(open_)
        span, open_cells = narrow_again(block, cells, replies)
        starts = block.starts(cells, open_cells)
        window = repeats.flags(block.window_keys(starts), replies, "before", "here")
        edge = np.zeros(len(block.data) + 1, np.int64)
        groups = zip(block.parts, block.split(whole, block.sizes), cells, block.split(span, [len(c[0]) for c in cells]), starts, block.split(window, [len(s) for s in starts]), strict=True)
        for p, w, (_, a, b, _, _), s, at, found in groups:
            for lo, hi in ((p.first[w], p.last[w]), (a[s], b[s]), (at[found], at[found])):
                edge += np.bincount(lo + p.base, minlength=len(edge)) - np.bincount(hi + length + p.base, minlength=len(edge)) if len(lo) else 0
        gone = np.cumsum(edge[:-1]) > 0
        if whole_characters:
            character = np.cumsum((block.data & 0xC0) != 0x80)
            gone = (np.bincount(character, gone) > 0)[character]
        removed = np.concatenate([[0], np.cumsum(gone)])
        at, to, rows = text.runs(gone, block.offsets)
        base = np.repeat(block.offsets[:-1], np.diff(rows))
        return pa.table({
            "id": table["id"], "kept": text.masked(block.data, block.offsets, ~gone, pa.binary()), "n_bytes": pa.array(np.diff(block.offsets), pa.int64()),
            "n_removed": pa.array(np.diff(removed[block.offsets]), pa.int64()), "spans": text.span_lists(at - base, to - base, rows),
        })

    replies = repeats.answers(repeats.send(blocks, first, buckets))
    for level in (second, third):
        replies = replies.unionByName(repeats.answers(repeats.send_again(blocks, replies, level, buckets)))
    schema = T.StructType([
        T.StructField("id", blocks.schema["id"].dataType), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(remove, schema).withColumnRenamed("id", id_col)
