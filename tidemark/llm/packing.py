"""Packing: order-preserving dynamic programming over document and sentence boundaries."""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE, HARD, RUN = 2, 8, 4
CHUNK_TOKENS = 1 << 20
#: The byte-level vocabulary's split pattern in its public form, and its text that
#: is one id by itself. Only \s+(?!\S) backtracks, see `token_ids`.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SPECIAL = {"<|endoftext|>": 50256}
#: Runs of white space (the pattern's \s) too long for its look-ahead.
LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, and for each id whether a sentence may end after it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ends = np.zeros(max(ranks.values()) + 2, bool)
    for piece, k in ranks.items():
        ends[k] = piece.rstrip(b" ").endswith((b".", b"!", b"?")) or b"\n" in piece
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL), ends


def token_ids(encode, body: str) -> list[np.ndarray]:
    """The ids of a text, in pieces.

    The pattern takes a run of white space without its last character, which may go with the
    next word, and whole at the end. Its look-ahead needs a step back for every character, which
    fails on a million of them; so a long run is handed over by itself, where it is an end."""
    begin, out = 0, []
    for run in LONG_BLANKS.finditer(body):
        end = run.end() if run.end() == len(body) or body.startswith(tuple(SPECIAL), run.end()) else run.end() - 1
        for a, b in ((begin, run.start()), (run.start(), end)):
            out.append(encode.encode_to_numpy(body[a:b], allowed_special="all", disallowed_special=()))
        begin = end
    return [*out, encode.encode_to_numpy(body[begin:], allowed_special="all", disallowed_special=())]


def cuts(positions: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """The boundaries at which the cheapest packing cuts, first 0 and last the end.

    positions: increasing, from 0; costs: what a cut there costs, in padding tokens.
    From boundary i to j the tokens fill whole windows, cut anywhere at HARD each, and
    a last window that is padded to size unless its length is a power of two. For a run
    of n windows, padding is n * size - (position j - position i), so the best i within
    the run's range of positions is a sliding minimum of cost(i) + position(i). Runs of
    one window keep it in a monotone queue. Longer runs start before the block of size
    positions that j is in, where all costs are known, so they are looked up a block at
    a time; powers of two are looked up by position."""
    count = len(positions)
    bits = count.bit_length()
    last = (1 << bits) - 1
    keys = np.full(count + 1, 1 << 62, np.int64)  # cost + position, then the later boundary first
    edges = [np.searchsorted(positions, positions - n * size) for n in range(RUN, 0, -1)]
    ranges = np.stack([e for pair in zip(edges, edges[1:], strict=False) for e in pair], 1)
    base = np.arange(RUN, 1, -1) * (size + HARD) - HARD
    never = np.where(ranges[:, 1::2] > ranges[:, ::2], 0, 1 << 40)
    limits, at, price = (last - edges[-1]).tolist(), positions.tolist(), costs.tolist()
    exact: dict[int, list[int]] = {}
    for p in (1 << k for k in range(4, size.bit_length() - 1)):
        i = np.searchsorted(positions, positions - p)
        for j in np.flatnonzero(positions[i] == positions - p).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    best, back, queue, block, keys[0] = [0], [0], deque([last]), 1, last
    while block < count:
        end = int(np.searchsorted(positions, positions[block] + size))
        key = np.minimum.reduceat(keys, ranges[block:end].ravel())[::2].reshape(-1, RUN - 1)
        cost = np.minimum(key >> bits, 1 << 40) + base + never[block:end]
        run = cost.shape[1] - 1 - cost[:, ::-1].argmin(axis=1)  # of equal costs the shorter run
        rows = np.arange(end - block)
        far, start = cost[rows, run] - positions[block:end], last - (key[rows, run] & last)
        for j, low, origin in zip(range(block, end), far.tolist(), start.tolist(), strict=True):
            here = at[j]
            while queue and queue[0] & last > limits[j]:
                queue.popleft()
            if queue:
                top = queue[0]
                near = (top >> bits) + size - here
                if near <= low:
                    low, origin = near, last - (top & last)
            if j in exact:
                for i in exact[j]:
                    if best[i] < low:
                        low, origin = best[i], i
            low += price[j]
            best.append(low)
            back.append(origin)
            own = (low + here) << bits | last - j
            while queue and queue[-1] >= own:
                queue.pop()
            queue.append(own)
        keys[block:end] = (np.array(best[block:end]) + positions[block:end]) << bits | last - np.arange(block, end)
        block = end
    path = [count - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return [at[i] for i in reversed(path)]


def windows(ends: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Bounds of all windows. ends: positions after each document; stops: after each sentence."""
    total = int(ends[-1])
    at = np.unique(np.concatenate([[0], ends, stops]))
    gaps = np.diff(at)
    long = np.flatnonzero(gaps > size)
    if len(long):  # a sentence longer than a window
        at = np.unique(np.concatenate([at, *(np.arange(at[i] + size, at[i + 1], size) for i in long)]))
    costs = np.full(len(at), HARD)
    costs[np.isin(at, stops)] = SENTENCE
    costs[np.isin(at, ends)] = 0
    bounds = cuts(at, costs, size)
    out = [0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        out += [*range(a + size, b, size), b]
    last = out.pop()
    if last > out[-1] and (last - out[-1]) & (last - out[-1] - 1):  # the chunk's rest, in powers of two
        while out[-1] < last:
            out.append(out[-1] + (1 << ((last - out[-1]).bit_length() - 1)))
    else:
        out.append(last)
    return np.array(out, np.int64)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if wanted).

    Documents, in the order of their partition, are token streams closed by end_id; a
    window of at most size tokens is a sequence. Cuts fall on document ends, sentence
    ends or, dearer, anywhere. A null text is empty: one piece of one token. Repeated
    rows and null ids are packed like any other. An empty table gives no row.

    vocabulary: path of a rank file that every executor can read. Narrow: tokens never
    leave their task; a task holds about a million tokens at a time. sequence_id counts
    on from the partition's number times 2**40."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends_sentence = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        names, streams, held = [], [], 0
        for batch in batches:
            begin = 0
            for k, body in enumerate(pc.fill_null(batch["text"], "").to_pylist()):
                streams.append(np.concatenate([*token_ids(encode, body), [end_id]]))
                held += len(streams[-1])
                if held >= CHUNK_TOKENS:
                    out, sequence = chunk([*names, batch["id"][begin : k + 1]], streams, ends_sentence, sequence)
                    yield out
                    names, streams, held, begin = [], [], 0, k + 1
            names.append(batch["id"][begin:])
        if streams:
            yield chunk(names, streams, ends_sentence, sequence)[0]

    def chunk(names: list, streams: list, ends_sentence: np.ndarray, sequence: int):
        tokens = np.concatenate(streams).astype("<u4")
        ends = np.cumsum([len(s) for s in streams])
        stops = np.flatnonzero(ends_sentence[np.minimum(tokens, len(ends_sentence) - 1)]) + 1
        bounds = windows(ends, stops[stops < len(tokens)], size)
        starts = np.unique(np.concatenate([bounds[:-1], ends[:-1]]))
        stop = np.append(starts[1:], len(tokens))
        doc = np.searchsorted(ends, starts, "right")
        window = np.searchsorted(bounds, starts, "right") - 1
        first = np.append(0, ends[:-1])
        raw = memoryview(tokens.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stop.tolist(), strict=True)]
        columns = [
            pa.concat_arrays(names).take(pa.array(doc)), pa.array(starts - first[doc]), pa.array(stop - starts), pa.array(crc, pa.int64()),
            pa.array((ends - first)[doc]), pa.array(window + sequence), pa.array(starts - bounds[window]),
        ]
        if ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(tokens)), pa.int32()), pa.array(tokens.astype(np.int32))))
        fields = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]
        return pa.RecordBatch.from_arrays(columns, fields), sequence + len(bounds) - 1

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
