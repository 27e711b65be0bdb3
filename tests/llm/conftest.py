from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and blank texts, ties, repeated rows, odd white space, wide letters.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "a b\u00a0c\x0bd\x0ce"), (7, "é" * 500), (8, "😀 " * 300), (None, "no id at all")]


@pytest.fixture
def table(spark):
    """Documents with an extra column whose name operators use inside."""

    def make(rows):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, n int")

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
