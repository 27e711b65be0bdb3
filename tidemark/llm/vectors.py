"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .shared import saved

CELL_ROWS, BLOCK_ROWS, MOST_CELLS, LARGE, ASKS, BROADCAST_CELLS = 1000, 1024, 4096, 8, 4096, 100_000


def spherical_kmeans(points: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit points; an empty cell takes the point that fits worst."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), cells, replace=False)]
    for _ in range(rounds):
        cosines = points @ centres.T
        near, fit = cosines.argmax(1), cosines.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        sums[empty] = points[np.argsort(fit)[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def matrix(column) -> np.ndarray:
    """Rows of equal length, scaled to unit vectors in double precision."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    values = np.asarray(flat, np.float64).reshape(len(column), -1)
    values = values / np.maximum(np.abs(values).max(axis=1, keepdims=True), 1e-300)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def visits(unit: np.ndarray, centres: np.ndarray, reach: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each unit vector, and which centroids it has to visit (the nearest too).

    Of x with nearest centroid c and y with nearest centroid d, x(c - d) and y(d - c) are not
    negative and add up to (x - y)(c - d) <= |x - y||c - d|. So for |x - y| <= 2 reach one of
    them is within reach |c - d|: that one visits the other's cell. At twice the reach both do."""
    cosines = unit @ centres.T
    home = cosines.argmax(1)
    kinds, at = np.unique(home, return_inverse=True)
    norms = (centres**2).sum(1)
    apart = np.sqrt(np.maximum(norms[kinds][:, None] + norms[None] - 2 * centres[kinds] @ centres.T, 0))[at]
    return home, cosines[np.arange(len(home)), home][:, None] - cosines <= reach * apart + 1e-9


def fit(classes: DataFrame, count: int, sample: int, cell_rows: int, most_cells: int) -> np.ndarray | None:
    """Centroids from at most about `sample` vectors of the commonest length."""
    if not count:
        return None
    width = classes.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()["n"]
    draw = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, sample / count) * (1 << 20))
    points = matrix(classes.where(draw & (F.size("vec") == width)).orderBy("rep").select("vec").toArrow()["vec"])
    cells = min(most_cells, max(1, count // cell_rows), len(points))
    return spherical_kmeans(points, cells) if cells else None


def refined(placed: DataFrame, sizes: DataFrame, reach: float, sample: int, cell_rows: int, most_cells: int) -> DataFrame:
    """The placed vectors, with large cells divided by centroids of their own (fitted on about `sample` vectors each).

    A vector of the cell visits others of its parts by the reach, a guest of the cell by twice
    the reach: it meets only residents. Cells whose vectors would visit a quarter of the parts
    or more stay whole, as dividing would not save work."""
    large = saved(sizes.where(F.col("count") > LARGE * cell_rows))
    if large.isEmpty():
        return placed

    def divide(table: pa.Table) -> pa.Table:
        points = matrix(table.sort_by("rep")["vec"])
        centres = spherical_kmeans(points, min(most_cells, table["count"][0].as_py() // cell_rows, len(points)))
        if visits(points[:BLOCK_ROWS], centres, reach)[1].mean() >= 0.25:
            centres = centres[:0]
        return pa.table({"cell": table["cell"][: len(centres)], "sub": pa.array(np.arange(len(centres))), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    def choose(rows: pa.Table, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("sub")
        centres = np.asarray(parts["centre"].combine_chunks().flatten(), np.float64).reshape(len(parts), -1)
        first = (1 << 52) + (parts["cell"][0].as_py() << 20)  # numbers of parts lie above all cells
        mine, subs, probes = rows["mine"].to_numpy(), [], []
        for at in range(0, len(rows), BLOCK_ROWS):
            own = mine[at : at + BLOCK_ROWS]
            home, close = visits(matrix(rows["vec"].slice(at, BLOCK_ROWS)), centres, reach * np.where(own, 1, 2)[:, None])
            close[own, home[own]] = False
            subs += [first + int(h) if m else None for h, m in zip(home, own, strict=True)]
            probes += [(first + np.flatnonzero(c)).tolist() for c in close]
        return pa.table({"rep": rows["rep"], "cell": rows["cell"], "sub": pa.array(subs, pa.int64()), "found": pa.array(probes, pa.list_(pa.int64()))})

    draw = F.pmod(F.xxhash64("rep", F.lit(6)), F.lit(1 << 20)) < F.lit(sample << 20) / F.col("count")
    drawn = placed.join(F.broadcast(large), placed["home"] == large["cell"]).where(draw).select("cell", "count", "rep", "vec")
    centroids = saved(drawn.groupBy("cell").applyInArrow(divide, "cell long, sub long, centre array<double>"))
    asked = placed.select("rep", "vec", "home", F.explode(F.concat(F.array("home"), "probes")).alias("cell"))
    divided = F.broadcast(centroids.select("cell").distinct())  # of at most MOST_CELLS cells and one per length
    loads = F.broadcast(saved(asked.join(divided, "cell").groupBy("cell").agg(F.ceil(F.count("*") / ASKS).alias("parts"))))
    asked = asked.join(loads, "cell").select("rep", "vec", "cell", (F.col("home") == F.col("cell")).alias("mine"), F.pmod(F.xxhash64("rep", F.lit(4)), "parts").alias("part"))
    known = centroids.join(loads, "cell").select("cell", "sub", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    moves = asked.groupBy("cell", "part").cogroup(known.groupBy("cell", "part")).applyInArrow(choose, "rep long, cell long, sub long, found array<long>")
    moves = moves.groupBy("rep").agg(F.max("sub").alias("sub"), F.flatten(F.collect_list("found")).alias("found"), F.collect_list("cell").alias("went"))
    stay = F.coalesce(F.array_except("probes", "went"), "probes")
    probes = F.concat(stay, F.coalesce("found", F.array().cast("array<long>")))
    return saved(placed.join(moves, "rep", "left").select("rep", "copies", "vec", F.coalesce("sub", "home").alias("home"), probes.alias("probes")))


def near_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, sample: int = 8192, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS
) -> DataFrame:
    """Columns id, n_links, component_id and kept, one row per input row.

    Links are pairs with cosine >= threshold; components follow links; the smallest id
    of a component is kept. Vectors that are null, zero or have null or non-finite parts,
    and vectors of different lengths, link with nothing. Equal vectors are one class
    (they link with each other), told by a 64-bit hash; repeated ids are separate vectors.
    A null id is linked like any other: its component is the smallest id that is no null,
    and it is kept only if no row of its component has an id. An empty table is fine.

    k-means is fitted on a bounded sample, in two levels: at most most_cells cells, and those
    of over eight times cell_rows vectors are divided again. Every vector is indexed in its
    nearest cell and looked up in all cells where a vector of the threshold's distance may
    lie (see `visits`), so pairs across a border are all found. Cells larger than a block are
    compared block by block, and no pair leaves a task: a block returns link counts and a
    spanning forest of its links.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.withColumn("rep", F.when(usable(F.col("vec")), F.xxhash64("vec")))
    good = rows.where("rep is not null")
    classes = saved(good.groupBy("rep").agg(F.first("vec").alias("vec"), F.min("id").alias("id"), F.count("*").alias("copies")))
    count = classes.count()
    centres = fit(classes, count, sample, cell_rows, most_cells)
    reach = max(0.0, (1 - threshold) / 2) ** 0.5  # half the distance of two unit vectors at the threshold

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["vec"].value_lengths().to_numpy()
            home, probes = -sizes.astype(np.int64), [[] for _ in sizes]  # other lengths: one cell each
            own = np.flatnonzero(sizes == centres.shape[1])
            for at in range(0, len(own), BLOCK_ROWS):
                some = own[at : at + BLOCK_ROWS]
                home[some], close = visits(matrix(batch["vec"].take(pa.array(some))), centres, reach)
                for row, near in zip(some, close, strict=True):
                    probes[row] = [int(c) for c in np.flatnonzero(near) if c != home[row]]
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["copies"], batch["vec"], pa.array(home), pa.array(probes, pa.list_(pa.int64()))], ["rep", "copies", "vec", "home", "probes"])

    def result(n_links, component) -> list[Column]:
        kept = F.coalesce(F.col("id") == component, component.isNull())
        return [F.col("id").alias(id_col), n_links.cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept")]

    if centres is None:
        return rows.select(*result(F.lit(0), F.col("id")))
    kinds = dict(classes.dtypes)
    placed = saved(classes.select("rep", "copies", "vec").mapInArrow(place, f"rep long, copies long, vec {kinds['vec']}, home long, probes array<long>"))
    placed = refined(placed, placed.groupBy(F.col("home").alias("cell")).count(), reach, sample, cell_rows, most_cells)
    sizes = placed.groupBy(F.col("home").alias("cell")).count()
    guests = placed.select(F.explode("probes").alias("cell")).groupBy("cell").count()
    cells = sizes.select("cell", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks")).join(guests.select("cell", F.ceil(F.col("count") / BLOCK_ROWS).alias("guests")), "cell", "left")
    cells = saved(cells)
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    blocks = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), n)
    home = placed.join(cells, placed["home"] == cells["cell"]).withColumn("block", blocks(F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    guests = F.when(F.coalesce("guests", F.lit(0)) > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("guests")), lambda g: F.struct(F.col("block").alias("a"), (-g).alias("b")))).otherwise(F.array())
    pairs = F.concat(F.transform(others, lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b"))), guests)
    columns = ["cell", "pair.a", "pair.b", "block", "rep", "copies", "vec", "home", "probes"]
    residents = home.withColumn("pair", F.explode(pairs)).select(*columns)
    guest = placed.withColumn("visit", F.explode("probes")).join(cells, F.col("visit") == cells["cell"])
    guest = guest.withColumn("block", -1 - blocks(F.col("guests"))).withColumn("pair", F.explode(F.transform(others, lambda o: F.struct(o.alias("a"), F.col("block").alias("b"))))).select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        block, rep, copies, home_ = (table[c].to_numpy() for c in ("block", "rep", "copies", "home"))
        probes = table["probes"].to_pylist() if b < 0 else None
        unit = matrix(table["vec"])
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        links, u, v = np.zeros(len(rep), np.int64), [], []
        for at in range(0, len(left), BLOCK_ROWS):
            for to in range(0, len(right), BLOCK_ROWS):
                x, y = left[at : at + BLOCK_ROWS], right[to : to + BLOCK_ROWS]
                i, j = np.nonzero(unit[x] @ unit[y].T >= threshold)
                i, j = x[i], y[j]
                if a == b:
                    i, j = i[i < j], j[i < j]
                elif b < 0 and len(i):  # found in both cells: the smaller one counts it
                    once = np.array([home_[q] not in probes[p] or home_[p] < home_[q] for p, q in zip(i, j, strict=True)], bool)
                    i, j = i[once], j[once]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                u.append(i)
                v.append(j)
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (u, v))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        root = np.empty(len(rep), np.int64)
        root[order] = roots(rank[u], rank[v], len(rep))
        own = links > 0
        return pa.table({"rep": pa.array(rep[own]), "n": pa.array(links[own]), "root": pa.array(rep[order[root[own]]])})

    found = saved(residents.unionByName(guest).groupBy("cell", "a", "b").applyInArrow(compare, "rep long, n long, root long"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = saved(classes.select("rep", "id", "copies").join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left"))
    firsts = known.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    known = known.join(firsts, "component", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    known = saved(known)
    linked = rows.where("rep is not null").select("id", "rep").join(known, "rep").select(*result(F.col("n_links"), F.col("component_id")))
    return linked.unionByName(rows.where("rep is null").select(*result(F.lit(0), F.col("id"))))
