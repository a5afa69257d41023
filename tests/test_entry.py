"""The driver's contract holds with the training-data subpackage and without it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from voxgrid.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)}, timeout=120)


def test_without_the_subpackage(tmp_path):
    """A copy without both folders imports and has every other query; a missing dependency isn't taken for a missing subpackage."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "voxgrid", tmp_path / "voxgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    got = run(tmp_path, "import __spark_entry__ as e; from voxgrid.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLE)")
    assert got.returncode == 0, got.stderr
    (tmp_path / "voxgrid/llm").mkdir()
    (tmp_path / "voxgrid/llm/__init__.py").write_text("")
    (tmp_path / "voxgrid/llm/catalog.py").write_text("import no_such_dependency\n")
    assert run(tmp_path, "import __spark_entry__").returncode != 0


def test_nothing_imports_the_subpackage():
    for p in (ROOT / "voxgrid").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "voxgrid").parts:
            assert "voxgrid.llm" not in p.read_text(), p
