"""UTF-8 text as numpy arrays: words, Rabin-Karp hashes of words and of windows.

All helpers work on the concatenated bytes of many documents, so no loop runs
per word. Hashes are polynomials modulo 2**64 over random byte values, then
mixed, so equal content always has equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK, PIECE = 1 << 20, 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits (a bijection)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


class Powers:
    """BASE**i and BASE**-i modulo 2**64, extended on demand."""

    up = down = np.ones(0, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + (CHUNK >> 2))
            for name, base in (("up", BASE), ("down", INVERSE)):
                values = np.full(size, base, U64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))
        return cls.up[:n], cls.down[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of value * BASE**i, one longer than the input."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * Powers.upto(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), the same wherever the span lies."""
    down = Powers.upto(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row boundaries; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Row ranges of about size bytes each; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about PIECE bytes of text: a batch of Spark's has a number of rows, whatever their length."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        for a, b in chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), PIECE):
            yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ([^\\x20\\x09-\\x0D]+, or runs of other bytes than gaps) and the first word of each row."""
    solid = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid & edge[:-1]
    starts[1:] |= solid[1:] & ~solid[:-1]
    ends = solid & edge[1:]
    ends[:-1] |= solid[:-1] & ~solid[1:]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Spans of all words, the first word of each row, and the words' hashes."""
    spans, hashes, first, base = [], [], [np.zeros(1, np.int64)], 0
    for a, b in chunks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if lower:
            part = LOWER[part]
        s, e, f = word_spans(part, own)
        hashes.append(span_hash(prefix_hash(BYTE_VALUES[part]), s, e))
        spans.append((s + offsets[a], e + offsets[a]))
        first.append(f[1:] + base)
        base += len(s)
    none = np.zeros(0, np.int64)
    return (
        np.concatenate([none, *(s for s, _ in spans)]),
        np.concatenate([none, *(e for _, e in spans)]),
        np.concatenate(first),
        np.concatenate([np.zeros(0, U64), *hashes]),
    )


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows of width words inside one row, and their Rabin-Karp hashes."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(hashes)) + width <= last)
    out = np.empty(len(at), U64)
    for a in range(0, len(at), CHUNK):  # the prefix restarts, so that powers stay in the table
        own = at[a : a + CHUNK]
        if len(own):
            base = own[0]
            prefix = prefix_hash(hashes[base : own[-1] + width])
            out[a : a + CHUNK] = span_hash(prefix, own - base, own - base + width)
    return at, out


def spread(flags: np.ndarray, width: int, size: int) -> np.ndarray:
    """True at every position covered by a window that starts at a flagged position."""
    edge = np.bincount(flags, minlength=size + 1) - np.bincount(np.minimum(flags + width, size), minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: starts, ends, first run of each row."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    starts = mask & edge[:-1]
    starts[1:] |= mask[1:] & ~mask[:-1]
    ends = mask & edge[1:]
    ends[:-1] |= mask[:-1] & ~mask[1:]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_lists(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """Arrow list<struct<start, end>> with one list for each row."""
    pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pairs)


def masked(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, kind=pa.string()) -> pa.Array:
    """The kept bytes of each row as an Arrow column."""
    total = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(total[offsets].astype(np.int32).tobytes()), pa.py_buffer(data[keep].tobytes())])
