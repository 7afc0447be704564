"""The entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_optional_subpackage(tmp_path):
    own = [n for n in names(ROOT) if n != "pipeline" and not n.startswith("op")]
    for part in ("with", "without"):  # the pipeline's file may be left behind, or gone as well
        shutil.copytree(ROOT, tmp_path / part, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if part == "without" else [])))
        assert names(tmp_path / part) == own
