"""The entry points with the training-data operators taken out, and with ones that are broken."""

import shutil
import subprocess
import sys
from pathlib import Path

from siltworks import queries as own

REPO = Path(__file__).resolve().parent.parent


def copied(tmp_path):
    shutil.copytree(REPO / "siltworks", tmp_path / "siltworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


def imported(folder):
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)


def test_the_rest_works_alone(tmp_path):
    assert imported(copied(tmp_path)).stdout.split() == [str(len(own.QUERIES)), str(len(own.ORACLE))]


def test_a_pipeline_without_its_operators_counts_as_taken_out(tmp_path):
    folder = copied(tmp_path)
    (folder / "corpus_pipeline.py").write_text("from siltworks.llm import lines\n")
    assert imported(folder).stdout.split() == [str(len(own.QUERIES)), str(len(own.ORACLE))]


def test_a_missing_dependency_is_no_silence(tmp_path):
    folder = copied(tmp_path)
    (folder / "siltworks" / "llm").mkdir()
    (folder / "siltworks" / "llm" / "__init__.py").write_text("")
    (folder / "siltworks" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    (folder / "corpus_pipeline.py").write_text("")
    found = imported(folder)
    assert found.returncode and "a_module_that_is_not_there" in found.stderr
