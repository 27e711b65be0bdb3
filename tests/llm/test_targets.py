"""Whitening, resampling and toxicity against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import contour, resampling, text, toxicity, whitening

from .conftest import ODD


def with_values(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    out = q @ np.diag(values) @ q.T
    return (out + out.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(0.01, 1, 64), np.full(20, 3.0), [5, 5, 5, 5, 5, 1, 1e-3, *[0] * 30], [2, 1, *[0] * 30], 1 + 1e-9 * np.arange(12), [2.0], 2.0 ** -np.arange(40), [1e6, 1, 0.1, 0.01, *[1e-4] * 9],
    np.linspace(1, 2, 9) * 1e12, np.linspace(1, 2, 9) * 1e-12, [0.0] * 4,
])
def test_largest_components(values):
    matrix = with_values(np.array(values, float))
    got, axes = contour.largest(matrix, 4)
    want = np.linalg.eigvalsh(matrix)[::-1]
    rank = int((want > want[0] * 1e-12).sum()) if want[0] > 0 else 0
    assert len(got) == min(4, rank)
    if rank:
        assert np.abs(got - want[: len(got)]).max() < 1e-13 * want[0] and np.abs(matrix @ axes - axes * got).max() < 1e-12 * want[0]
        assert np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-12
        shifts = [(a + b) / 2 for a, b in zip(want, want[1:], strict=False) if a - b > 1e-6 * want[0]]
        assert [contour.above(matrix, s) for s in shifts] == [int((want > s).sum()) for s in shifts]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, x string, n int")


def test_whitening(spark):
    rng = np.random.default_rng(5)
    points = (rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12) + 40).astype(np.float32)
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    rows += [(k, points[7].tolist()) for k in range(300, 460)] + [(7, points[7].tolist()), (None, points[8].tolist()), (500, [0.0] * 12)]
    odd = [(600, None), (601, [1.0] * 11 + [None]), (602, [float("nan")] * 12), (603, [float("inf")] * 12), (604, []), (605, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    assert Counter(r["vec_id"] for r in got) == Counter(i for i, _ in rows for _ in range(4))
    x = [np.floor(256 * np.array(v, np.float64)).astype(np.int64) for _, v in rows]
    fit = np.unique(np.array(x), axis=0)
    n, sums = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    byid = {i: v for (i, _), v in zip(rows, x, strict=True)}
    for k in range(4):
        own = [r for r in got if r["component"] == k + 1]
        want = np.array([(byid[r["vec_id"]] - sums / n) @ axes[:, k] / values[k] ** 0.5 for r in own])
        found = np.array([r["whitened"] for r in own])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-9
        assert all(abs(r["explained"] - values[k] / np.trace(np.cov(fit.T, bias=True))) < 1e-12 for r in own)
    assert all(r["n"] == n and r["deviation"] == int(((n * byid[r["vec_id"]] - sums) ** 2).sum()) and r["identity_error"] < 1e-9 for r in got)


def test_whitening_without_components(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])).collect()  # a line
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 12), round(r["explained"], 12)) for r in one) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {None}


def crc_features(body):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (body or "").encode().translate(bytes(text.LOWER)))
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(docs, target):
    source, wanted = Counter(), Counter()
    for _, body in docs:
        source.update(crc_features(body)[1])
    for body in target:
        wanted.update(crc_features(body)[1])
    a, b = sum(source.values()), sum(wanted.values())
    gain = lambda k: math.floor(1000 * math.log((wanted[k] + 1) * (a + 10000) / ((source[k] + 1) * (b + 10000))))
    out = []
    for i, body in docs:
        n, found = crc_features(body)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: 5 * len(order) // 100])}
    return Counter((*r, ranks.get(id(r))) for r in out)


def resampled(spark, docs, target, **more):
    out = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **more).collect()
    return Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in out)


@pytest.mark.parametrize("block_rows", [7, 1 << 18])
def test_resampling(spark, table, documents, block_rows):
    docs = documents + ODD + [(-5 - 2**40 * k, t) for k, (_, t) in enumerate(documents[:40])] + [(2**62, "w " * 40), (2**62, "w " * 40), (None, "Straße 9 " * 30), (77, "long" * 300_000 + " " + "tail " * 25)]
    target = [t for _, t in documents[:9]] + [None, "", "ÄB12 c"]
    assert resampled(spark, table(docs), target, block_rows=block_rows) == brute_resample(docs, target)


def test_resampling_of_empty_tables(spark, table, documents):
    assert resampled(spark, table([]), ["a b"]) == Counter()
    assert resampled(spark, table(documents[:30]), []) == brute_resample(documents[:30], [])
    assert resampled(spark, table([(1, None), (None, "")]), ["a"]) == brute_resample([(1, None), (None, "")], ["a"])


@pytest.mark.parametrize(("width", "block_rows"), [(3, 5), (16, 64), (4, 1000)])
def test_radix_places(spark, width, block_rows):
    """Any digit width and block size; ties keep the order of the scan, a hot digit is no hot block."""
    from tidemark.llm.shared import saved

    draw = random.Random(width)
    rows = [(draw.choice((0, 0, 0, draw.randrange(5000))), draw.choice((7, 7, draw.randrange(1 << 40))), k) for k in range(400)]
    from pyspark.sql import functions as F

    frame = saved(spark.createDataFrame(rows, "low long, high long, k long").repartition(3).withColumn("place", F.monotonically_increasing_id()))
    before = {r["k"]: r["place"] for r in frame.collect()}
    got = resampling.radix_places(frame, ["low", "high"], block_rows, width).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(400))
    assert [r["k"] for r in got] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[0], before[r[2]]))]


def spans(body):
    return re.findall(rb"[A-Za-z\x80-\xff]+", (body or "").lower().encode())


def own_terms(body):
    words = [w.decode() for w in spans(body)]
    return Counter([("=", w) for w in words] + [("^", w[:k]) for w in words for k in toxicity.PREFIXES if len(w) >= k])


def name_of(kind, word):
    data = np.frombuffer(word.encode(), np.uint8)
    value = text.span_hash(text.prefix_hash(text.BYTE_VALUES[data]), np.array([0]), np.array([len(data)]))[0]
    return int(value & ~toxicity.ONE) if kind == "=" else int(value | toxicity.ONE)


def test_terms(documents):
    bodies = [t for _, t in documents[:40]] + ["", None, "Öl übermäßig 漢字漢字漢字漢字 abcd abcde a1b2"]
    data, offsets = text.utf8(__import__("pyarrow").array([None if t is None else t.lower() for t in bodies]))
    found = [Counter() for _ in bodies]
    for a, _, rows, words, places, begins in toxicity.terms(data, offsets):
        for row, name in zip(np.concatenate([rows, places]).tolist(), np.concatenate([words, begins]).tolist(), strict=True):
            found[a + row][name] += 1
    assert found == [Counter({name_of(*t): n for t, n in own_terms(b).items()}) for b in bodies]


def test_nearest_is_exact():
    """Block-max search against all cosines, with ties, for many queries."""
    rng = np.random.default_rng(8)
    count, size = 700, 40
    weights = np.where(rng.random((count, size)) < 0.1, np.round(rng.random((count, size)), 1), 0)
    weights[300:420] = weights[5]  # ties
    example, place = np.nonzero(weights)
    index = toxicity.BlockMax(example, place, weights[example, place], count, size)
    for trial in range(60):
        query = np.where(rng.random(size) < 0.15, rng.random(size).round(1), 0) if trial else weights[5]
        at = np.flatnonzero(query)
        sums = weights @ query
        for k, without in ((1, -1), (15, -1), (15, 310), (900, -1)):
            want = [i for i in np.lexsort((np.arange(count), -sums.round(9))) if sums[i] > 0 and i != without][:k]
            ids, cosines = index.nearest(at, query[at], k, without)
            assert np.allclose(cosines, sums[want]) and sorted(sums[ids].round(9)) == sorted(sums[want].round(9))
            if trial == 0 and k <= 15:
                assert ids.tolist() == want


def test_vectors_and_frequencies(spark, table):
    """TF-IDF weights of a trained model against plain counting."""
    draw = random.Random(4)
    bodies = [" ".join(draw.choice(("alpha", "beta", "gamma", "deltas", "omegaaa", "noise%d" % draw.randrange(50))) for _ in range(30)) + (" nastyword" * draw.randrange(1, 3) if k % 4 == 0 else "") for k in range(200)]
    docs = [(k, b) for k, b in enumerate(bodies)] + [(None, "nastyword alone"), (900, None)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(150)] + [(None, 1, "x"), (5000, 1, "x"), (3, None, "x")], "doc_id long, toxic int, id string")
    model = toxicity.train(table(docs), labels)
    assert len(model.ids) == 150 and model.label.sum() == 38
    df = Counter(t for _, b in docs for t in own_terms(b))
    idf = lambda t: math.log((len(docs) + 1) / (df[t] + 1)) + 1
    places = {int(n): k for k, n in enumerate(model.weighing.names)}
    assert {int(model.weighing.names[k]) for k in np.flatnonzero(model.weighing.marked)} == {name_of(*t) for t in (("=", "nastyword"), ("^", "nast"), ("^", "nasty"), ("^", "nastyw"))}
    labelled = Counter(t for k in range(150) for t in own_terms(bodies[k]))
    twice = Counter(t for k in range(150) for t in set(own_terms(bodies[k])))
    for body in (bodies[0], bodies[160], "nastyword unseenword"):
        data, offsets = text.utf8(__import__("pyarrow").array([body.lower()]))
        (_, _, _, at, weight), = model.weighing.vectors(data, offsets)
        counts = own_terms(body)
        rare = math.log(len(docs) + 1) + 1
        norm = math.sqrt(sum(((1 + math.log(n)) * (idf(t) if twice[t] > 1 else rare)) ** 2 for t, n in counts.items() if t[0] == "="))
        want = {places[name_of(*t)]: (1 + math.log(n)) * idf(t) / norm for t, n in counts.items() if t[1] in ("nastyword", "nast", "nasty", "nastyw") and (t[0] == "^" or t[1] == "nastyword")}
        assert dict(zip(at.tolist(), weight.tolist(), strict=True)) == pytest.approx(want)
    assert labelled
    out = {r["doc_id"]: r for r in toxicity.score(table([*docs, (950, "nothing"), (951, ""), (960, "nastyword of alpha"), (960, "nastyword of alpha")]), model).collect()}
    assert out[960]["predicted"] == 1 and out[None]["predicted"] == 1 and out[960]["evidence"][0]["label"] == 1
    assert {out[k]["predicted"] for k in (900, 950, 951, 161)} == {0} and out[950]["evidence"] == []


def test_toxicity_without_labels(spark, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(table(ODD), toxicity.train(table(ODD), none)).collect()} == {0.5}
    clean = spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(table(ODD), toxicity.train(table(ODD), clean)).collect()} == {0}
    assert toxicity.score(table([]), toxicity.train(table([]), clean)).count() == 0


def test_toxicity_of_held_out_labels(spark):
    """On the given tables: ranks well, is mostly right, and hardly ever marks a document without a toxic label."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    marks = {i: t for i, t in duckdb.execute(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()}
    held = {i for i in marks if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, t) for i, t in marks.items() if i not in held], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=2000)
    assert len(model.ids) <= 2100
    from pyspark.sql import functions as F

    rows = toxicity.score(docs.where(F.col("doc_id").isin(list(held))), model).collect()
    bad, good = ([r["score"] for r in rows if marks[r["doc_id"]] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    caught, wrong = np.mean([s >= 0.5 for s in bad]), np.mean([s >= 0.5 for s in good])
    assert auc > 0.93 and caught > 0.85 and wrong < 0.03
