"""The library without its removable parts still imports and keeps all its other queries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as c; print(len(c.queries()), any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in c.queries()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_import_without_text_operators(tmp_path, with_pipeline):
    shutil.copytree(REPO / "taxweave", tmp_path / "taxweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if with_pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    number, text_queries = done.stdout.split()[-2:]
    assert int(number) >= 69 and text_queries == "False"
