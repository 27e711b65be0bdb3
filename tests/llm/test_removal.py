"""Substring, suffix and line dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from .conftest import ODD, WORD

from tidemark.llm import lines, substrings, suffixes


def brute_substrings(rows, width):
    first: dict = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, " ".join(w for w, g in zip(words, gone, strict=True) if not g), len(words), sum(gone)))
    return sorted(out)


def brute_suffixes(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((i, bytes(b for b, g in zip(t, gone, strict=True) if not g), len(t), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return sorted(out, key=repr)


def test_substrings(table, documents):
    rows = documents + [(100_000 + k, t[len(t) // 3 :]) for k, (_, t) in enumerate(documents[:30])]
    got = sorted((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(table(rows)).collect())
    assert got == brute_substrings(rows, 13)


def test_substrings_of_odd_rows(table):
    rows = [r for r in ODD if r[0] is not None] + [(9, "q " * 20), (10, "q " * 30), (10, "q " * 30)]
    out = substrings.substring_dedup(table(rows), width=3).collect()
    assert sorted((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in out) == brute_substrings(rows, 3)
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out}[10] == [(0, 30)]
    last = substrings.substring_dedup(table([(None, "a b c d"), (3, "x a b c")]), width=3).collect()
    assert {r["doc_id"]: r["text"] for r in last} == {None: "d", 3: "x a b c"}


def test_blocks_of_one_id_and_of_none(table, monkeypatch):
    """Rows of one id, and rows without one, are cut into many blocks and still are no copies of each other."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 300)
    rows = [(7, f"a b c d e {k % 3} f g h") for k in range(60)] + [(k, f"{k} a b c d") for k in range(30)] + [(None, "g h i j 5") for _ in range(40)] + [(None, "a b c d")]
    out = substrings.substring_dedup(table(rows), width=3).collect()
    key = lambda i: 1 << 40 if i is None else i
    want = Counter((i if i < 1 << 40 else None, t, n, m) for i, t, n, m in brute_substrings([(key(i), t) for i, t in rows], 3))
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in out) == want


def test_long_texts(table):
    """Texts of over a MB, and rows that repeat, against brute force or by what is left."""
    body = " ".join(f"w{k}" for k in range(180_000))
    rows = [(1, body), (2, "x " + body), (3, "y " * 20 + " ".join(body.split()[:900]))]
    got = {r["doc_id"]: r for r in substrings.substring_dedup(table(rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "x" and got[3]["n_removed"] == 900
    left = {r["doc_id"]: r for r in suffixes.suffix_dedup(table([*rows[:2], (4, "z" * 300)])).collect()}
    assert [bytes(left[k]["kept"]) for k in (1, 2, 4)] == [b"", b"x ", b""]
    twice = suffixes.suffix_dedup(table([(None, body[:900])] * 40)).collect()
    assert all(r["n_removed"] == 900 for r in twice)


@pytest.mark.parametrize("base", [2**53, 2**60, -(2**63), 2**63 - 7])
def test_substrings_of_large_ids(table, monkeypatch, base):
    """Neighbouring ids stay apart and in order where doubles can't tell them, in one block and in many."""
    body = " ".join(f"w{k}" for k in range(3000))
    rows = [(base + k, body) for k in range(6)] + [(5, body), (base + 6, "one two three")]
    for size in (1 << 22, 1 << 12):
        monkeypatch.setattr(substrings, "BLOCK_BYTES", size)
        got = sorted((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(table(rows)).collect())
        assert got == brute_substrings(rows, 13)


def test_substrings_of_one_id_in_many_blocks(table, monkeypatch):
    """Rows of one id are no copies of each other, also where they fill several blocks; larger ids lose the words."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1 << 10)
    texts = [" ".join(f"v{j}-{k % 7}" for j in range(40)) for k in range(60)]
    rows = [(9, t) for t in texts] + [(10, texts[3]), (None, texts[4]), (8, "short")]
    got = {(r["doc_id"], r["n_removed"]) for r in substrings.substring_dedup(table(rows)).collect()}
    assert got == {(9, 0), (10, 40), (None, 40), (8, 0)}


def test_suffixes(table, documents):
    rows = documents[:120] + [(100_000 + k, t[7 : 7 + len(t) // 2] + t[:300]) for k, (_, t) in enumerate(documents[:40])]
    got = sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], len(r["spans"])) for r in suffixes.suffix_dedup(table(rows)).collect()), key=repr)
    assert got == brute_suffixes(rows, 200)


def test_buckets_are_refined_by_later_offsets():
    """Equal buckets are equal strings, at all widths, and nothing but the q-grams is read."""
    import numpy as np

    data = np.frombuffer((b"abcab" * 60)[:280] + bytes(range(120)) + (b"abcab" * 60)[:250], np.uint8)
    assert suffixes.widths(200, 50) == [50, 100, 200] and suffixes.widths(50, 20) == [20, 25, 50] and suffixes.widths(200, 48) == [48, 96, 100, 200] and suffixes.widths(50, 48) == [48, 50]
    part = suffixes.anchors(data, np.array([0, len(data)]), 0, 200, 50)
    for level, width in enumerate(part.widths):
        at = np.arange(len(data) - width + 1)
        strings = [data[k : k + width].tobytes() for k in at]
        number = {x: k for k, x in enumerate(dict.fromkeys(strings))}
        names = dict.fromkeys(part.bucket(at, level).tolist())
        assert [number[x] for x in strings] == [dict(zip(names, range(len(names)), strict=True))[b] for b in part.bucket(at, level).tolist()]


@pytest.mark.parametrize("length", [50, 200])
def test_suffixes_of_odd_rows(table, length):
    rows = [*ODD, (11, "ab" * 400), (12, "z" * length), (13, "z" * (length + 1)), (14, "é" * 500)]
    got = sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], len(r["spans"])) for r in suffixes.suffix_dedup(table(rows), length=length, gram=20).collect()), key=repr)
    assert got == brute_suffixes(rows, length)


def test_whole_characters_stay_valid(table):
    rows = [(1, "x" + "é" * 200 + "ü" * 90), (2, "é" * 200 + "ö" * 90)]
    for r in suffixes.suffix_dedup(table(rows), whole_characters=True).collect():
        bytes(r["kept"]).decode()


def test_empty_tables(table):
    assert substrings.substring_dedup(table([])).count() == 0
    assert suffixes.suffix_dedup(table([])).count() == 0


def sites(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, line string")


def test_lines(spark):
    boiler, close = "All rights reserved here.", "Seen on one site fewer."
    rows = [(k, f"own line number {k}\n{boiler}  \n" + (close if k < 7 else "") + "\n\nok", f"s{k}", "x") for k in range(8)]
    rows += [(20, None, "s1", "x"), (21, "", "s2", "x"), (22, f"{boiler}\n{boiler}", None, "x"), (23, boiler, "s1", "x"), (23, boiler, "s1", "x")]
    got = {r["doc_id"]: r for r in lines.line_dedup(sites(spark, rows)).collect()}
    assert boiler in got[0]["text"] and got[0]["n_removed"] == 0
    assert all(got[k]["n_removed"] == 1 and boiler not in got[k]["text"] for k in range(1, 8))
    assert got[3]["text"] == f"own line number 3\n{close}\n\nok"
    assert got[20]["text"] is None and got[20]["n_lines"] == 0 and got[21]["text"] == "" and got[22]["text"] == "" and got[23]["text"] == ""
    assert lines.line_dedup(sites(spark, [])).count() == 0
    assert set(got[0].asDict()) == {"doc_id", "text", "source", "line", "n_lines", "n_removed"}


def test_lines_of_many_sites_are_counted_by_sketch(spark):
    rows = [(k, f"a line on many sites\nand one on a few {k % 40}", f"s{k}", "x") for k in range(400)]
    got = lines.line_dedup(sites(spark, rows), sites=20).collect()
    assert sum(r["n_removed"] for r in got) == 399  # ten sites each are below the threshold


def test_hash_of_kept_bytes(table):
    (r,) = suffixes.suffix_dedup(table([(1, "plain")])).collect()
    assert hashlib.sha256(bytes(r["kept"])).hexdigest() == hashlib.sha256(b"plain").hexdigest()


def test_unknown_and_empty_sites(spark):
    line = "A line that stands on every site."
    rows = [(1, line, "", "x"), (2, line, "b", "x"), (3, line, None, "x"), (4, line, "", "x"), (5, line, "b", "x"), (6, line, None, "x")]
    got = lines.line_dedup(sites(spark, rows), sites=2).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert all(r["n_removed"] == 0 for r in lines.line_dedup(sites(spark, rows), sites=3).collect())
    clash = spark.createDataFrame([(*r[:3], 7, 8, 9) for r in rows], "doc_id long, text string, source string, key long, gone long, left long")
    out = lines.line_dedup(clash, sites=2).collect()
    assert sum(r["n_removed"] for r in out) == 5 and all((r["key"], r["gone"], r["left"]) == (7, 8, 9) for r in out)


def test_a_document_of_many_removed_lines(spark):
    many = "\n".join(f"boilerplate line number {k}" for k in range(15_000))
    rows = [(k, many if k > 1 else f"{many}\nown words of the first", f"s{k}", "x") for k in range(1, 4)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.line_dedup(sites(spark, rows), sites=3).collect()}
    assert got == {1: (15_001, 0), 2: (15_000, 15_000), 3: (15_000, 15_000)}


def test_lines_of_megabyte_texts(spark):
    """One line of a megabyte on eight sites goes as a whole; a text of 60,000 lines keeps its own ones in order."""
    long, many = "wide " * 250_000, "\n".join(f"own line number {k}" for k in range(60_000))
    rows = [(k, f"{long}\nown {k}", f"s{k}", "x") for k in range(8)] + [(30, many, "s1", "x")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.line_dedup(sites(spark, rows)).collect()}
    assert got[0] == (2, 0, f"{long}\nown 0") and all(got[k] == (2, 1, f"own {k}") for k in range(1, 8))
    assert got[30] == (60_000, 0, many)


def test_lines_of_rows_without_an_id(spark):
    """Such rows lose what their own text has, whatever other rows without an id lose; repeated ones alike."""
    shared = [f"shared line number {k:03d}" for k in range(100)]
    rows = [(k, "\n".join(shared), f"s{k}", "x") for k in range(3)]
    rows += [(None, f"{shared[k]}\nown line of row {k}", f"s{k % 3}", "x") for k in range(100)] + [(None, f"{shared[5]}\nown line of row 5", "s9", "x")] * 20
    rows += [(None, "\n".join([*shared, "at the end"]), "s1", "x"), (None, None, "s1", "x"), (None, "", None, "x")]
    got = lines.line_dedup(sites(spark, rows), sites=3).collect()
    assert len(got) == len(rows)
    texts = Counter(r["text"] for r in got)
    assert texts["\n".join(shared)] == 1 and texts["at the end"] == 1 and texts[""] == 3 and texts[None] == 1
    assert texts["own line of row 5"] == 21 and all(texts[f"own line of row {k}"] == 1 for k in range(100) if k != 5)


@pytest.mark.parametrize("size", [1, 64, 65, 1000])
def test_search_in_sorted_lists(spark, size):
    held = sorted(7 * k - 300 for k in range(size))
    df = spark.createDataFrame([(held, k) for k in [*range(-310, 7 * size - 290), None]], "held array<long>, k long")
    got = {r["k"]: r["found"] for r in df.select("k", lines.listed(F.col("held"), F.col("k")).alias("found")).collect()}
    assert got == {k: k in set(held) for k in got}
