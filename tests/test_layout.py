"""The corpus operators can be taken away; everything else goes on without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

QUERIES = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 40 and "ledger_rollup" in names and set(e.oracle_sql()) <= names, names
assert not [n for n in names if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in names, names
"""
BLOCKED = "import sys\nsys.modules[{name!r}] = None\n" + QUERIES
ONE_RUNS = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


def without_corpus(tmp_path, *gone):
    """A copy of the repository without the corpus folders, whether or not they are still there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in ("tallyspring/llm", "tests/llm", *gone):
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    return copy


def run(folder, *command, timeout=900):
    """The environment stays, but for this repository's own place on the path."""
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(path)}
    return subprocess.run([sys.executable, *command], cwd=folder, env=env, capture_output=True, text=True, timeout=timeout)


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_entry_points_without_corpus_operators(tmp_path, gone):
    done = run(without_corpus(tmp_path, *gone), "-c", QUERIES)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["public_tokenizers", "xxhash"])
def test_entry_points_without_a_module_that_corpus_operators_need(name):
    done = run(ROOT, "-c", BLOCKED.format(name=name) + ONE_RUNS)
    assert done.returncode == 0, done.stderr


def test_other_errors_in_the_subpackage_show(tmp_path):
    copy = without_corpus(tmp_path)
    (copy / "tallyspring/llm").mkdir()
    (copy / "tallyspring/llm/__init__.py").write_text("")
    (copy / "tallyspring/llm/queries.py").write_text("1 / 0\n")
    done = run(copy, "-c", QUERIES)
    assert done.returncode != 0 and "ZeroDivisionError" in done.stderr


def test_remaining_tests_without_corpus_operators(tmp_path):
    """All are collected; every query, and the reads of landing rows, run. The others need minutes and nothing more."""
    copy = without_corpus(tmp_path)
    found = run(copy, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert found.returncode == 0, found.stdout
    done = run(copy, "-m", "pytest", "tests/test_ledger_queries.py", "tests/test_sources.py", "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout
