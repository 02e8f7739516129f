"""What the driver imports."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from quillstone.plans import catalog

ROOT = Path(entry.__file__).parent


def test_queries_and_their_sql():
    found = entry.queries()
    assert set(catalog.QUERIES) <= set(found) and set(entry.oracle_sql()) <= set(found) and len(found) >= 120


def test_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quillstone", tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["True", "True"]


def test_an_error_in_the_subpackage_is_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quillstone", tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "quillstone/llm").mkdir()
    (tmp_path / "quillstone/llm/__init__.py").write_text("")
    (tmp_path / "quillstone/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert said.returncode and "a_module_that_is_not_there" in said.stderr
