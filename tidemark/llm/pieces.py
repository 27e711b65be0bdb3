"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Candidate merges wait in an agenda, best score first, then leftmost. When a candidate's
turn comes, a keyed hash of the seed, the row's id, the word's place and the candidate's
span decides whether it is skipped. Words are encoded many at a time: each round takes
the top of every word's agenda at once, so the result is that of one heap per word. A
word of more than LONG letters, for which rounds would be quadratic, has a heap of its own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

U64 = np.uint64
SPACE, CHUNK = "▁", 1 << 19
NONE = np.int64(1 << 62)
LONG, MASK = 256, (1 << 64) - 1


class Pieces:
    """A BPE model with byte fallback: symbols, merges in order, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = {p: i for i, p in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces cross words")
        self.byte = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte[int(names[i][3:-1], 16)] = i
        raw = [p.replace(SPACE, " ").encode() if p in plain else bytes([int(p[3:-1], 16)]) if model.is_byte(i) else b"" for i, p in enumerate(names)]
        self.bytes, self.starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        # Symbols are the pieces, then letters that only stand inside pieces.
        symbols = dict(plain)
        for p in plain:
            for c in p:
                symbols.setdefault(c, size + len(symbols))
        self.symbols, self.size, self.plain = symbols, size, plain
        order = {p: k for k, p in enumerate(sorted(plain, key=lambda p: (-model.get_score(plain[p]), plain[p])))}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 24) | b] = (order[p], i)
        self.pairs = np.array(sorted(pairs), np.int64)
        self.rank, self.result = (np.array([pairs[k][j] for k in self.pairs.tolist()], np.int64) for j in (0, 1))
        letters = sorted((ord(" " if c == SPACE else c), s) for c, s in symbols.items() if len(c) == 1)
        self.agenda = pairs
        self.letters, self.letter_symbols = (np.array([x[j] for x in letters], np.int64) for j in (0, 1))
        self.spell = {s: c for c, s in symbols.items() if len(c) == 1 and s >= size}

    def of_letters(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for letters in no piece and for the space mark itself."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where((self.letters[at] == points) & (points != ord(SPACE)), self.letter_symbols[at], -1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def skipped(keys: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """The keyed coin of each candidate merge of [start, middle) and [middle, end)."""
    mark = text.mix(keys ^ (start.astype(U64) << U64(42)) ^ (middle.astype(U64) << U64(21)) ^ end.astype(U64))
    return (mark >> U64(11)).astype(float) < dropout * float(1 << 53)


def mixed(x: int) -> int:
    """text.mix of one number."""
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def agenda_heap(model: Pieces, symbols: list[int], key: int, dropout: float, merges: list) -> list[tuple[int, int]]:
    """Starts and symbols of one word's final pieces; merges takes (start, middle, end)."""
    limit = dropout * float(1 << 53)
    end, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols)))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        m = end[a]
        if m < len(symbols) and (hit := model.agenda.get(symbols[a] << 24 | symbols[m])):
            b = end[m]
            if limit <= 0 or (mixed(key ^ a << 42 & MASK ^ m << 21 & MASK ^ b) >> 11) >= limit:
                heapq.heappush(agenda, (hit[0], a, m, b, hit[1]))

    for a in range(len(symbols)):
        offer(a)
    while agenda:
        _, a, m, b, piece = heapq.heappop(agenda)
        if end[a] != m or end[m] != b:  # one of the two is gone or has grown
            continue
        merges.append((a, m, b))
        symbols[a], end[a], end[m] = piece, b, -1
        before[b] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < len(symbols):
        out.append((a, symbols[a]))
        a = end[a]
    return out


def agenda_rounds(model: Pieces, symbols: np.ndarray, first: np.ndarray, keys: np.ndarray, dropout: float, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words, and each word's first. first: word bounds in symbols; keys: of words.

    merges: takes (word, start, middle, end) of every merge made."""
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(len(symbols)) - first[word]
    end = start + 1
    done: list[tuple] = []
    for w in np.flatnonzero(np.diff(first) > LONG).tolist():
        made: list[tuple[int, int, int]] = []
        left = np.array(agenda_heap(model, symbols[first[w] : first[w + 1]].tolist(), int(keys[w]), dropout, made), np.int64)
        done.append((np.full(len(left), w), left[:, 0], left[:, 1]))
        if merges is not None and made:
            merges.append((np.full(len(made), w), *np.array(made, np.int64).T))
    if done:
        short = np.diff(first)[word] <= LONG
        symbols, word, start, end = symbols[short], word[short], start[short], end[short]
    while len(symbols):
        same = word[1:] == word[:-1]
        pair = (symbols[:-1] << 24) | symbols[1:]
        at = np.minimum(np.searchsorted(model.pairs, pair), len(model.pairs) - 1)
        at = np.where(same & (model.pairs[at] == pair), at, -1)
        live = np.flatnonzero(at >= 0)
        if dropout > 0 and len(live):
            live = live[~skipped(keys[word[live]], start[live], end[live], end[live + 1], dropout)]
        order = np.full(len(symbols), NONE)
        order[live] = (model.rank[at[live]] << 32) | start[live]
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        top = np.minimum.reduceat(order, heads)
        busy = np.repeat(top < NONE, np.diff(np.append(heads, len(symbols))))
        if not busy.all():
            done.append((word[~busy], start[~busy], symbols[~busy]))
        take = np.flatnonzero(order == np.repeat(top, np.diff(np.append(heads, len(symbols))))) if len(live) else live
        take = take[order[take] < NONE]
        if merges is not None:
            merges.append((word[take], start[take], end[take], end[take + 1]))
        symbols[take] = model.result[at[take]]
        end[take] = end[take + 1]
        busy[take + 1] = False
        symbols, word, start, end = symbols[busy], word[busy], start[busy], end[busy]
    if not done:
        return symbols, np.zeros(len(first), np.int64)
    word, start, symbols = (np.concatenate([d[k] for d in done]) for k in range(3))
    order = np.lexsort((start, word))
    return symbols[order], np.searchsorted(word[order], np.arange(len(first)))


def gather(bounds: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the picked ranges one after another, and where each begins."""
    sizes = np.diff(bounds)[picks]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(begin[-1]) + np.repeat(bounds[:-1][picks] - begin[:-1], sizes), begin


def encode_rows(model: Pieces, data: np.ndarray, offsets: np.ndarray, names: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and each row's first id."""
    rows = len(offsets) - 1
    lengths = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    full = np.flatnonzero(np.diff(lengths))
    points = np.insert(points, lengths[full], 0x20)  # the prefix space
    row = np.repeat(np.arange(rows), np.diff(lengths) + (np.diff(lengths) > 0))
    symbol = model.of_letters(points)
    space, odd = points == 0x20, symbol < 0
    new = np.ones(len(points), bool)
    new[1:] = (row[1:] != row[:-1]) | (space[1:] & ~space[:-1]) | odd[1:] | odd[:-1]
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(points))
    prefix = text.prefix_hash(text.mix(points.astype(U64) + U64(1)))
    word = text.span_hash(prefix, begin, stop)
    own = row[begin]
    turn = np.arange(len(begin)) - np.searchsorted(own, own)
    _, example, which = np.unique(word, return_index=True, return_inverse=True)

    def laid(picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the letters of the picked words, and where each begins."""
        begins = np.concatenate([[0], np.cumsum((stop - begin)[picks])])
        return np.arange(begins[-1]) + np.repeat(begin[picks] - begins[:-1], np.diff(begins)), begins

    at, spans = laid(example)
    letters, values = symbol[at], points[at]
    merges: list[tuple] = []
    known, first = agenda_rounds(model, np.where(letters < 0, 0, letters), spans, np.zeros(len(example), U64), 0.0, merges if dropout > 0 else None)
    if merges:
        # An occurrence whose coins keep all merges of the plain word ends like it; any other has an agenda of its own.
        key = text.mix(word + text.mix(text.mix(names[own] ^ U64(seed)) + turn.astype(U64)))
        owner, *span = (np.concatenate([m[k] for m in merges]) for k in range(4))
        order = np.argsort(owner, kind="stable")
        at, ends = gather(np.searchsorted(owner[order], np.arange(len(example) + 1)), which)
        at, turns = order[at], np.repeat(np.arange(len(which)), np.diff(ends))
        varied = np.unique(turns[skipped(key[turns], *(x[at] for x in span), dropout)])
        at, begins = laid(varied)
        other, bounds = agenda_rounds(model, symbol[at], begins, key[varied], dropout)
        which[varied] = len(example) + np.arange(len(varied))
        known, first = np.concatenate([known, other]), np.concatenate([first, bounds[1:] + len(known)])
    # A word of one unknown letter, and letters left over that are no piece, become bytes.
    lone = np.flatnonzero(letters[spans[:-1]] < 0) if len(example) else np.zeros(0, np.int64)
    spelled = [np.zeros(0, np.int64)]
    sizes = np.diff(first)
    patch: dict[int, np.ndarray] = {}
    for w in lone:
        patch[int(w)] = model.byte[np.frombuffer(chr(values[spans[w]]).encode(), np.uint8)]
    over = np.unique(np.searchsorted(first, np.flatnonzero(known >= model.size), "right") - 1)
    for w in over:
        parts = [model.byte[np.frombuffer(model.spell[int(s)].encode(), np.uint8)] if s >= model.size else np.array([s]) for s in known[first[w] : first[w + 1]]]
        patch[int(w)] = np.concatenate(parts)
    base, bounds = len(known), first.copy()
    starts, sizes = first[:-1].copy(), sizes.copy()
    for w, ids in patch.items():
        starts[w], sizes[w] = base, len(ids)
        spelled.append(ids)
        base += len(ids)
    known = np.concatenate([known, *spelled])
    count = sizes[which]
    bounds = np.concatenate([[0], np.cumsum(count)])
    ids = known[np.arange(bounds[-1]) + np.repeat(starts[which] - bounds[:-1], count)]
    return ids, bounds[np.searchsorted(own, np.arange(rows + 1))]


def decode_rows(model: Pieces, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and each row's first byte; the prefix space is dropped."""
    at, begin = gather(model.starts, ids)
    data, offsets = model.bytes[at], begin[first]
    keep = np.ones(len(data), bool)
    full = offsets[:-1][np.diff(offsets) > 0]
    keep[full[data[full] == 0x20]] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], total[offsets]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = 0.0) -> DataFrame:
    """The id and `ids` (array of int) of every row; without dropout as the library encodes.

    dropout: the chance that a candidate merge is skipped. Every occurrence of a word has
    coins of its own, by the seed, the row's id and the word's place, so equal words differ
    within and between documents, and a rerun gives the same ids on any partitioning.
    A null text is null, an empty one has no ids. Every segmentation decodes to the text:
    letters in no piece, and the space mark itself, are spelled in byte pieces.
    model: path that every executor can read. Narrow, about half a MB of text at a time."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            data, offsets = text.utf8(batch["text"])
            names = batch["name"].to_numpy().view(U64)
            for a, b in text.chunks(offsets, CHUNK):
                ids, first = encode_rows(table, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], names[a:b], seed, dropout)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                lists = lists if not batch["text"].null_count else pa.array([None if t is None else x for t, x in zip(batch["text"][a:b].to_pylist(), lists.to_pylist(), strict=True)], lists.type)
                yield pa.RecordBatch.from_arrays([batch["id"][a:b], lists], ["id", "ids"])

    name = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id, text, n_ids and ids_crc32 (of little-endian 32-bit ids) of every row; null ids give a null text."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            sizes = np.nan_to_num(np.asarray(batch["ids"].value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            for a, b in text.chunks(np.concatenate([[0], np.cumsum(sizes)]), CHUNK >> 2):
                lists = batch["ids"][a:b]
                first, ids = np.concatenate([[0], np.cumsum(sizes[a:b])]), lists.flatten().to_numpy()
                data, offsets = decode_rows(table, ids.astype(np.int64), first)
                raw = memoryview(ids.astype("<i4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), first[1:].tolist(), strict=False)]
                texts = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                if lists.null_count:
                    texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([batch["id"][a:b], texts, pa.array(sizes[a:b]), pa.array(crc, pa.int64())], ["id", "text", "n_ids", "ids_crc32"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string, n_ids long, ids_crc32 long").withColumnRenamed("id", id_col)
