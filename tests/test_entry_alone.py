"""The entry points without the optional training-data part, in whole and in part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
PROBE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and "graph_risk" in q and not any(n.startswith("op") and n[2].isdigit() for n in q) and "pipeline" not in q
"""


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm", "corpus_pipeline.py"), ("tessera/llm", "tests/llm")])
def test_imports_without(tmp_path, gone):
    left_out = shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    for name in gone:
        target = copy / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    subprocess.run([sys.executable, "-c", PROBE], cwd=copy, check=True, timeout=120)
