"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one class. A token of one class only is shared
with nothing, so a class with too many of them can't be similar to any other: two exact
counts by token, first of a sample of the hash range and then of what is left, settle
most classes. The others are partitioned into groups of similar documents (a least token
in common, then linked inside the group, cut by size). A row of the token-group matrix
is a group's token union, stored. Two components meet where a rare token stands in the
prefixes of both unions; a query document's overlap with a group's union then bounds its
similarity to every member, and only groups whose bound qualifies are opened and
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .components import components, roots
from .shared import saved

U64 = np.uint64
CELLS = 1 << 21  # of both matrices at once
GROUP, QUERIES, LEVELS, KEYS, BROADCAST_ROWS = 48, 256, 4, 3, 500_000


def token_sets(column, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are lower-cased (A-Z).

    A text with fewer words than width has one token, its whole sequence."""
    data, offsets = text.utf8(column)
    out = []
    for a, b in text.chunks(offsets, 8 * text.CHUNK):
        _, _, first, hashes = text.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        at, windows = text.window_hashes(hashes, first, width)
        cuts = np.searchsorted(at, first)
        for k in range(b - a):
            own = windows[cuts[k] : cuts[k + 1]]
            if not len(own) and first[k + 1] > first[k]:
                short = hashes[first[k] : first[k + 1]]
                own = text.span_hash(text.prefix_hash(short), np.array([0]), np.array([len(short)]))
            out.append(np.unique(own))
    return out


def pieces_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with the token sets of their texts; a worker holds one piece's sets at a time, not a batch's."""
    for piece in text.pieces(batches):
        yield piece, token_sets(piece["text"], width)


def class_of(tokens: np.ndarray) -> int:
    """Number of the class of all equal sets: a hash of the set."""
    sums = np.array([text.mix(tokens).sum(dtype=U64), text.mix(tokens ^ U64(text.BASE)).sum(dtype=U64), len(tokens)], U64)
    return int(text.mix(text.prefix_hash(text.mix(sums))[-1:]).view(np.int64)[0])


def least(tokens: np.ndarray, k: int) -> int:
    """Least token under the k-th hash: equal for two sets with the chance of their similarity."""
    return int(text.mix(text.mix(tokens ^ U64(k)).min(keepdims=True) ^ U64(k)).view(np.int64)[0])


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow list<int64> of unsigned hashes."""
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, U64), *arrays]).view(np.int64)))


def arrays(column) -> list[np.ndarray]:
    """The other way round."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)
    flat = column.flatten().to_numpy().view(U64)
    return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two bounded lists of sets, as products of 0-1 matrices."""
    shared = np.zeros((len(left), len(right)))
    kinds = np.unique(np.concatenate([np.zeros(0, U64), *right]))
    if not len(kinds) or not left:
        return shared

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the ones, by column."""
        row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1).astype(np.int32)
        known = kinds[at] == flat
        row, at = row[known], at[known]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (a, x), (b, y) = cells(left), cells(right)
    step = max(1, CELLS // (len(left) + len(right)))
    for lo in range(0, len(kinds), step):
        size = min(step, len(kinds) - lo)
        one, two = np.zeros((len(left), size), np.float32), np.zeros((len(right), size), np.float32)
        for matrix, row, at in ((one, a, x), (two, b, y)):
            part = slice(*np.searchsorted(at, [lo, lo + size]))
            matrix[row[part], at[part] - lo] = 1
        shared += one @ two.T
    return shared


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs reach the similarity."""
    shared = overlaps(left, right)
    total = np.array([len(s) for s in left], float)[:, None] + np.array([len(s) for s in right], float)[None]
    return 100 * shared >= percent * (total - shared)


def links_within(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of a bounded group."""
    return np.nonzero(np.triu(linked(sets, sets, percent), 1))


def lonely(tokens: DataFrame) -> DataFrame:
    """cls and u: how many tokens of a class no other class has. tokens: rows (token, cls).

    Minimum and maximum combine on the map side, so a frequent token is no hot key."""
    ends = tokens.groupBy("token").agg(F.min("cls").alias("cls"), F.max("cls").alias("other"))
    return ends.where("cls = other").groupBy("cls").agg(F.count("*").alias("u"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Columns id, n_shingles and component_id (smallest id reachable by links), one row per input row.

    Words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) form distinct shingles of width words. Two
    documents link when 100 * intersection >= percent * union. A text without words, or a
    null one, has no shingles and links with nothing; so does a row with a null id. Repeated
    ids: each row goes by its own set, component_id is the smallest id of the rows reached.
    Texts may be of any length. Other columns are ignored. Equal shingles, and equal sets,
    are told by 64-bit hashes.

    Plan: one pass describes the documents, one counts sampled tokens; from there on only
    the token sets of classes that may still be similar to another move. No pair within a
    known component is compared again, so a group of near copies costs its size times a
    group's, not its square. Ids whose texts are wanted are broadcast up to half a million;
    beyond that they are joined by a shuffle.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)["id"]
    most = U64(min(2**64 - 1, 2 * (100 - percent) * 2**64 // 100))  # at this share of the hash range, half unshared is enough to tell

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in pieces_of(batches, width):
            cls = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(s) for s in sets], pa.int64()), cls], ["id", "n", "cls"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in pieces_of(batches, width):
            some = [s[: np.searchsorted(s, most)] for s in sets]  # sets are sorted
            cls = np.repeat(np.array([class_of(s) if len(s) else 0 for s in sets], np.int64), [len(s) for s in some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U64), *some]).view(np.int64)), pa.array(cls)], ["token", "cls"])

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only rows of the class that was asked for: a repeated id may have other texts."""
        for batch, sets in pieces_of(batches, width):
            own = [k for k, (s, c) in enumerate(zip(sets, batch["cls"].to_pylist(), strict=True)) if len(s) and class_of(s) == c]
            sets = [sets[k] for k in own]
            keys = pa.array([[least(s, k) for k in range(1, KEYS + 1)] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["cls"].take(pa.array(own, pa.int64())), pa.array([len(s) for s in sets], pa.int64()), keys, lists(sets)], ["cls", "n", "keys", "tokens"])

    def may_link(rows: DataFrame, alone: DataFrame) -> DataFrame:
        return rows.join(alone, "cls", "left").where(100 * F.coalesce("u", F.lit(0)) <= (100 - percent) * F.col("n")).drop("u")

    described = saved(docs.mapInArrow(describe, f"id {id_type}, n long, cls long"))
    classes = saved(described.where("n > 0 and id is not null").groupBy("cls", "n").agg(F.min("id").alias("rep")))
    alone = lonely(docs.where("id is not null").select("text").mapInArrow(sampled, "token long, cls long"))
    wanted = saved(may_link(classes, alone).select("rep", "cls"))
    count = wanted.count()
    texts = docs.join(F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted, F.col("id") == F.col("rep")).select("cls", "text")
    open_ = saved(texts.mapInArrow(tokens_of, "cls long, n long, keys array<long>, tokens array<long>"))
    if open_.count() > count:  # rows that repeat
        open_ = saved(open_.dropDuplicates(["cls"]))
    live = saved(may_link(open_, lonely(open_.select(F.explode("tokens").alias("token"), "cls"))))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows whose key others have too, dealt into parts of about GROUP rows."""
        counts = saved(rows.groupBy("key").count().where("count > 1"))
        parts = F.ceil(F.col("count") / GROUP).alias("parts")
        return rows.join(counts, "key").select(*rows.columns, parts, F.pmod(F.xxhash64("cls", F.lit(11)), parts).alias("part"))

    def link(table: pa.Table) -> pa.Table:
        order = np.argsort(table["cls"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        found = arrays(table["tokens"])
        root = roots(*links_within(found, percent), len(found))
        return pa.table({"key": table["key"], "cls": table["cls"], "leader": table["cls"].take(pa.array(root)), "parts": table["parts"]})

    links = []
    met = saved(dealt(live.select(F.explode("keys").alias("key"), "cls")))
    for _ in range(LEVELS):  # leaders of a key's parts meet again; what stays apart is left to the matrix
        groups = met.join(live.select("cls", "tokens"), "cls").groupBy("key", "part")
        out = saved(groups.applyInArrow(link, "key long, cls long, leader long, parts long"))
        links.append(out.where("cls <> leader").select(F.col("cls").alias("u"), F.col("leader").alias("v")))
        leaders = out.where("parts > 1 and cls = leader").select("key", "cls")
        if leaders.isEmpty():
            break
        met = saved(dealt(leaders))
    near = components(reduce(DataFrame.unionByName, links))

    # Groups: parts of a component of about equal size. The matrix: the token union of each group.
    sized = live.join(near, live["cls"] == near["id"], "left").select("cls", "n", F.coalesce("component", "cls").alias("comp"), F.floor(F.log("n") / np.log(1.08)).alias("size"))
    sized = saved(sized)
    counts = saved(sized.groupBy("comp", "size").count())
    part = F.pmod(F.xxhash64("cls", F.lit(13)), F.ceil(F.col("count") / GROUP))
    placed = saved(sized.join(counts, ["comp", "size"]).select("cls", "n", "comp", F.xxhash64("comp", "size", part).alias("grp")))

    def union(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        tokens = lists([np.unique(np.concatenate(arrays(table["tokens"])))])
        return pa.table({"grp": pa.array([key[0].as_py()]), "comp": table["comp"][:1], "lo": pa.array([n.min()]), "hi": pa.array([n.max()]), "tokens": tokens})

    with_tokens = placed.join(live.select("cls", "tokens"), "cls")
    matrix = saved(with_tokens.groupBy("grp").applyInArrow(union, "grp long, comp long, lo long, hi long, tokens array<long>"))

    # Tokens of two components or more, rare ones first; links need one within both prefixes.
    cells = matrix.select(F.explode("tokens").alias("token"), "grp", "comp")
    across = saved(cells.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token", "df"))
    rows = cells.join(across, "token").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))  # a group's union bounds the list
    rows = rows.join(matrix.select("grp", "comp", "lo", "hi"), "grp").withColumn("s", F.size("shared"))
    probe = F.col("s") - F.ceil(percent * F.col("lo") / 100) + 1
    index = F.col("s") - F.ceil(2 * percent * F.col("lo") / (100 + percent)) + 1
    prefix = rows.where(probe > 0).select("comp", "lo", "hi", "s", index.alias("index"), F.posexplode(F.slice("shared", F.lit(1), probe.cast("int"))).alias("pos", "x"))
    prefix = saved(prefix.select(F.col("x.token").alias("token"), "comp", "lo", "hi", (F.col("s") - F.col("pos")).alias("room"), (F.col("pos") < F.col("index")).alias("indexed")))
    ends = (F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("room").alias("room"))  # room: how many tokens can be common from here on
    larger = prefix.groupBy("token", "comp").agg(*ends).withColumnsRenamed({"comp": "p", "lo": "p_lo", "hi": "p_hi", "room": "p_room"})
    smaller = prefix.where("indexed").groupBy("token", "comp").agg(*ends)
    room = F.least("room", "p_room")
    fits = (F.col("p") != F.col("comp")) & (F.col("lo") <= F.col("p_hi")) & (percent * F.col("p_lo") <= 100 * F.col("hi")) & ((100 + percent) * room >= percent * (F.col("lo") + F.col("p_lo")))
    met = larger.join(smaller, "token").where(fits).select(F.least("p", "comp").alias("a"), F.greatest("p", "comp").alias("b"), room.alias("room"))
    met = saved(met.groupBy("a", "b").agg(F.max("room").alias("room")))
    # Documents of the smaller component ask the groups of the other.
    weights = saved(placed.groupBy("comp").agg(F.count("*").alias("weight")))
    sides = met.join(weights.withColumnsRenamed({"comp": "a", "weight": "x"}), "a").join(weights.withColumnsRenamed({"comp": "b", "weight": "y"}), "b")
    sides = sides.select(F.when(F.col("x") <= F.col("y"), F.col("a")).otherwise(F.col("b")).alias("own"), F.when(F.col("x") <= F.col("y"), F.col("b")).otherwise(F.col("a")).alias("comp"), "room")
    asks = sides.join(placed.select(F.col("comp").alias("own"), "cls", "n"), "own")
    fits = (percent * F.col("n") <= 100 * F.col("hi")) & (percent * F.col("lo") <= 100 * F.col("n")) & ((100 + percent) * F.col("room") >= percent * (F.col("lo") + F.col("n")))
    pairs = saved(asks.join(matrix.select("grp", "comp", "lo", "hi"), "comp").where(fits).select("cls", "grp"))

    def in_parts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries with their token sets, at most about QUERIES in a part of a group, and the parts of each group."""
        parts = saved(pairs.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("parts")))
        queries = pairs.join(parts, "grp").select("grp", F.pmod(F.xxhash64("cls", F.lit(19)), "parts").alias("part"), "cls")
        return queries.join(live.select("cls", "n", "tokens"), "cls"), parts.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def bound(queries: pa.Table, group: pa.Table) -> pa.Table:
        """Queries whose overlap with the union leaves room for a similar member."""
        own, n = arrays(queries["tokens"]), queries["n"].to_numpy()
        lo, hi = (group[c][0].as_py() for c in ("lo", "hi"))
        shared = np.minimum(overlaps(own, arrays(group["tokens"]))[:, 0], np.minimum(n, hi))
        other = np.maximum(lo, shared)  # the member size that fits best
        return queries.filter(pa.array(100 * shared >= percent * (n + other - shared))).select(["cls", "grp"])

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        """A link to one member for each query that has any: the members are one component."""
        hit = linked(arrays(queries["tokens"]), arrays(members["theirs"]), percent)
        some = pa.array(np.flatnonzero(hit.any(axis=1)))
        return pa.table({"u": queries["cls"].take(some), "v": members["member"].take(pa.array(hit.argmax(axis=1))).take(some)})

    queries, parts = in_parts(pairs)
    unions = parts.join(matrix.select("grp", "lo", "hi", "tokens"), "grp")
    qualified = saved(queries.groupBy("grp", "part").cogroup(unions.groupBy("grp", "part")).applyInArrow(bound, "cls long, grp long"))
    queries, parts = in_parts(qualified)
    members = parts.join(with_tokens.select("grp", F.col("cls").alias("member"), F.col("tokens").alias("theirs")), "grp")
    more = queries.groupBy("grp", "part").cogroup(members.groupBy("grp", "part")).applyInArrow(compare, "u long, v long")
    final = components(near.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(saved(more)))

    firsts = saved(final.join(classes, final["id"] == classes["cls"]).groupBy("component").agg(F.min("rep").alias("first")))
    groups = final.join(firsts, "component").select(F.col("id").alias("cls"), "first")
    known = saved(classes.join(groups, "cls", "left").select("cls", F.coalesce("first", "rep").alias("component_id")))
    nothing = F.col("cls").isNull() | F.col("id").isNull()
    alone = described.where(nothing).select("id", "n", F.col("id").alias("component_id"))
    out = described.where(~nothing).join(known, "cls").select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
