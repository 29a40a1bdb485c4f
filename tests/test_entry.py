"""The driver's entry without the optional training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_entry_imports_without_the_optional_operators(tmp_path, pipeline_left):
    shutil.copytree(ROOT / "basketry", tmp_path / "basketry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline_left:
        (tmp_path / "corpus_pipeline.py").write_text("from basketry.llm import nothing\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n[:2] in ('op', 'pi')))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 100 and done.stdout.strip().endswith("[]")
