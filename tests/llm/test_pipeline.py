"""Every pipeline stage against a brute-force version on its own input, then the whole run."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidemark.llm import quality

from .test_links import brute
from .test_removal import brute_suffixes
from .test_texts import counted, stream

DIR = "/root/testdata/sf0.001"


def rules_hold(found, text):
    n, chars, symbols, dup, repeat = counted(text)
    lines = sum(1 for x in text.split("\n") if x.strip(" \t\x0b\x0c\r"))
    share = lambda a, b: a / b if b else 0.0
    upper, digits, shout = (sum(c in s for c in text) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!"))
    values = dict(zip(quality.RATIOS, (n, share(chars, n), share(symbols, chars), share(dup, lines), share(repeat, n), share(upper, chars), share(digits, chars), share(shout, chars)), strict=True))
    return any(all((values[t.feature] > t.value) == t.above for t in rule) for rule in found)


def without_lines(rows):
    sites, first = defaultdict(set), {}
    trim = lambda x: x.strip(" \t\x0b\x0c\r")
    for r in rows:
        for x in map(trim, (r["text"] or "").split("\n")):
            if len(x) >= 10:
                sites[x] |= {r["source"]} - {None}
                first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    gone = lambda r, x: len(x) >= 10 and len(sites[x]) >= 8 and first[x] != r["doc_id"]
    return {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if not gone(r, trim(x))) for r in rows}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [("documents", docs, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.saved(stage(spark, out[-1][1], DIR))
        out.append((name, df, df.collect()))
    return out


def test_columns(stages):
    for _, df, _ in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_quality(spark, stages):
    docs, before, after = stages[0][1], stages[0][2], stages[1][2]
    found = quality.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id", "text", "quality")
    want = set()
    for r in before:
        n, *_, repeat = counted(r["text"])
        if n >= 10 and 100 * repeat <= 20 * n and not rules_hold(found, r["text"] or ""):
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in after} == want and len(want) > 0.7 * len(before)


def test_line_dedup(stages):
    assert {r["doc_id"]: r["text"] for r in stages[2][2]} == without_lines(stages[1][2])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][2])


def test_near_duplicates(stages):
    groups = brute([(r["doc_id"], r["text"]) for r in stages[2][2]], 5, 80)
    assert {r["doc_id"] for r in stages[3][2]} == {i for i, _, g in groups if i == g}


def test_passages(stages):
    removed = {i: n for i, _, _, n, _ in brute_suffixes([(r["doc_id"], r["text"]) for r in stages[3][2]], 200)}
    before = {r["doc_id"]: r["text"].encode() for r in stages[3][2]}
    for r in stages[4][2]:
        lost = len(before[r["doc_id"]]) - len(r["text"].encode())
        assert removed[r["doc_id"]] <= lost <= removed[r["doc_id"]] + 40  # the rest of cut characters


def test_packing(stages):
    want = {r["doc_id"]: len(stream(r["text"])) for r in stages[4][2]}
    got = defaultdict(int)
    for r in stages[5][2]:
        assert r["doc_tokens"] == want[r["doc_id"]]
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_and_odd_documents(spark, stages):
    assert corpus_pipeline.run(spark, DIR).count() == len(stages[5][2])
    rows = [(None, "no id " * 30, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "short", "en", "s", 5), (4, " ".join(f"w{k}" for k in range(60)), "en", "s", 9), (4, " ".join(f"w{k}" for k in range(60)), "en", "s", 9)]
    odd = spark.createDataFrame(rows, stages[0][1].schema)
    for start in (odd, odd.where("false")):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, DIR))
        assert docs.count() >= 0
    for _, stage in corpus_pipeline.STAGES[1:]:  # rows that the quality stage would have taken out
        assert stage(spark, odd, DIR).count() >= 5


def test_repeated_rows_keep_one_text(spark, stages):
    schema = stages[0][1].schema
    body = lambda seed: " ".join(f"{seed}{k}" for k in range(70))
    rows = [(1, body("a")), (1, body("a")), (2, body("b")), (2, body("c")), (None, body("d")), (None, body("d")), (None, body("a")), (None, body("e")), (3, body("c")), (4, body("f")), (5, body("f")), (6, None), (7, "")]
    assert all(len(t) >= 200 for _, t in rows if t)
    odd = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], schema)
    near = corpus_pipeline.saved(corpus_pipeline.near_stage(spark, odd, DIR))
    want = [(1, body("a")), (2, body("b")), (2, body("c")), (None, body("d")), (None, body("e")), (4, body("f")), (6, None), (7, "")]
    assert near.columns == odd.columns
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter(want)
    left = corpus_pipeline.passage_stage(spark, near, DIR)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(want)
    for order in (odd.orderBy("source"), odd.repartition(5)):
        assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, order, DIR).collect()) == Counter(want)
