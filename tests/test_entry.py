"""The driver contract holds without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "quillstone", tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'lexical_bm25' in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "quillstone").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "quillstone.llm" not in path.read_text(), path
