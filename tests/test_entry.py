"""Registration with and without the corpus subpackage, in a process of its own."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def registered(folder):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr
    total, corpus, pipeline = done.stdout.split()
    return int(total), int(corpus), pipeline == "True"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_without_the_corpus_subpackage(tmp_path, pipeline_stays):
    from tidemark.queries import QUERIES

    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=ignore)
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline_stays):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    assert registered(tmp_path) == (len(QUERIES), 0, False)


def test_as_it_is():
    from tidemark.queries import QUERIES

    total, corpus, _ = registered(ROOT)
    assert total >= len(QUERIES) and (corpus in (0, 13) or not (ROOT / "tidemark" / "llm").exists())


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "__init__.py").write_text("import no_such_module_at_all")
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module_at_all" in done.stderr
