"""Jaccard join, embeddings and components against brute force."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard, vectors
from tidemark.llm.components import components

from .conftest import ODD, WORD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    linked = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    group = classes({i for i, _ in rows}, linked)
    return sorted((i, len(s), group[i]) for i, s in sets)


def edited(text, rate, seed):
    draw = random.Random(seed)
    return " ".join(f"w{draw.random()}" if draw.random() < rate else w for w in text.split(" "))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(table, documents, width, percent):
    rows = documents[:80] + [(10_000 + k, edited(documents[k % 9][1], 0.002 * (k % 14), k)) for k in range(150)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(table(rows), width=width, percent=percent).collect())
    assert got == brute(rows, width, percent)


def test_jaccard_of_a_passage_and_a_family(table):
    """A common passage links nothing; a family of near copies larger than a group is one component."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    rows = [(k, f"{' '.join(word() for _ in range(90))} {passage}") for k in range(70)]
    rows += [(1000 + k, edited(" ".join(base), 0.012, k)) for k in range(150)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(table(rows), width=4, percent=85).collect())
    assert got == brute(rows, 4, 85)


def peak_mb(work):
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_jaccard_memory_of_a_batch(table, monkeypatch):
    """What a worker holds of one batch does not grow with the batch's text."""
    steps, frame = {}, type(table([]))
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda docs, step, *rest: run(docs, steps.setdefault(step.__name__, step), *rest))
    jaccard.jaccard_join(table([(k, "a text of six words twice") for k in range(2)] + [(2, "a text of six words once")]), width=4, percent=50)
    batch = pa.RecordBatch.from_pydict({"id": list(range(6000)), "text": [" ".join(f"w{k}x{j}" for j in range(500)) for k in range(6000)]})
    list(steps["describe"]([batch.slice(0, 10)]))  # tables of powers stay
    cls = pa.concat_arrays([b["cls"] for b in steps["describe"]([batch])])
    asked = pa.RecordBatch.from_arrays([cls, batch["text"]], ["cls", "text"])
    for step, rows in (("describe", batch), ("sampled", batch), ("tokens_of", asked)):
        assert peak_mb(lambda: sum(b.num_rows for b in steps[step]([rows]))) < 12, step  # noqa: B023


def test_jaccard_memory_of_a_product():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 2**63, 1400).astype(np.uint64)) for _ in range(48)]
    asking = [sets[k % 48][: 100 + k] for k in range(256)]
    got = []
    assert peak_mb(lambda: got.append(jaccard.overlaps(asking, sets))) < 32
    assert (got[0] == [[len(a) if k % 48 == j else 0 for j in range(48)] for k, a in enumerate(asking)]).all()


def test_jaccard_of_odd_rows(table):
    rows = [r for r in ODD if r[0] is not None] + [(20, "ONE"), (21, "one two"), (22, "one two")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(table(rows), width=4, percent=85).collect())
    assert got == brute(rows, 4, 85)
    assert jaccard.jaccard_join(table([])).count() == 0
    (r,) = jaccard.jaccard_join(table([(None, "a text")])).collect()
    assert r["component_id"] is None and r["n_shingles"] == 1


def test_components(spark):
    draw = random.Random(1)
    pairs = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(draw.randrange(2000, 2400), draw.randrange(2000, 2400)) for _ in range(260)] + [(5, 5), (7, 6)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(7)).collect()}
    want = classes({x for p in pairs for x in p}, pairs)
    assert got == {i: g for i, g in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2600, 16))
    near = base[:600] + rng.normal(size=(600, 16)) * 0.08 * np.linalg.norm(base[:600], axis=1, keepdims=True)
    points = np.concatenate([base, near, np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_dedup(frame(spark, [(k, v.tolist()) for k, v in enumerate(points)])).collect()}
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    degree = np.bincount(np.concatenate([i, j]), minlength=len(points))
    found = sum(n for n, _, _ in got.values())
    assert found >= 0.99 * degree.sum() and all(got[k][0] <= degree[k] for k in range(len(points)))  # recall; nothing below the threshold
    assert got[3200][0] >= 30 and got[3200][1] == 0 and got[0][2] and not got[3200][2]
    if found == degree.sum():
        want = classes(range(len(points)), zip(i.tolist(), j.tolist(), strict=True))
        assert {k: v[1] for k, v in got.items()} == want


@pytest.mark.parametrize("threshold", [0.95, 0.9])
def test_cells_in_two_levels(spark, monkeypatch, threshold):
    """Eight cells only, so they are divided; no pair across any border is missed."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1500, 48)) + 3 * np.repeat(rng.normal(size=(60, 48)), 25, axis=0)
    near = points[:700] + rng.normal(size=(700, 48)) * rng.uniform(0.1, 0.6, size=(700, 1))
    points = np.concatenate([points, near, rng.normal(size=(1, 48))]).astype(np.float32)
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    degree = np.bincount(np.concatenate([i, j]), minlength=len(points))
    want = classes(range(len(points)), zip(i.tolist(), j.tolist(), strict=True))
    homes, refined = [], vectors.refined
    monkeypatch.setattr(vectors, "refined", lambda *a: homes.append(refined(*a)) or homes[0])
    rows = frame(spark, [(k, v.tolist()) for k, v in enumerate(points)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_dedup(rows, threshold=threshold, cell_rows=20, most_cells=8).collect()}
    assert got == {k: (degree[k], want[k]) for k in range(len(points))}
    assert homes[0].where("home >= 1L << 40").select("home").distinct().count() > 8


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, []), (10, [1e-30, 1e-30])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_dedup(frame(spark, rows)).collect())
    alone = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 8, 9)]
    assert got == sorted([*alone, (6, 3, 6, True), (7, 3, 6, False), (7, 3, 6, False), (10, 3, 6, False)])
    named = [(None, [1.0, 0.0]), (4, [1.0, 0.1]), (None, [2.0, 0.0]), (9, [0.0, 1.0]), (None, [-1.0, -1.0]), (None, None)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_dedup(frame(spark, named)).collect())
    assert got == [("4", 2, "4", True), ("9", 0, "9", True), ("None", 0, "None", True), ("None", 0, "None", True), ("None", 2, "4", False), ("None", 2, "4", False)]
    assert vectors.near_dedup(frame(spark, [])).count() == 0
    assert vectors.near_dedup(frame(spark, [(1, None)])).first()["kept"]


def test_jaccard_of_texts_of_over_a_megabyte(table):
    draw = random.Random(9)
    body = " ".join(f"w{draw.randrange(100_000)}" for _ in range(200_000))
    rows = [(3, body), (2, edited(body, 0.01, 1)), (9, edited(body, 0.2, 2)), (1, "a short one")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(table(rows)).collect())
    assert len(body) > 1_000_000 and got == brute(rows, 5, 80)


def test_jaccard_of_repeated_rows_and_ids(table):
    """Rows that repeat hundreds of times are one class; an id with two texts has each judged by itself."""
    draw = random.Random(3)
    text = lambda: " ".join(f"w{draw.randrange(10_000)}" for _ in range(80))
    a, b = text(), text()
    rows = [(7, a)] * 300 + [(5, f"{a} end")] * 2 + [(7, b), (8, f"{b} end"), (None, a), (None, text())]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(table(rows)).collect())
    assert got == {(7, 76, 5): 300, (5, 77, 5): 2, (7, 76, 7): 1, (8, 77, 7): 1, (None, 76, None): 2}
    out = jaccard.jaccard_join(table(rows[:302])).collect()
    assert len(out) == 302 and {r["component_id"] for r in out} == {5}
