import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_contract(spark, data):
    assert entry.entry(spark).count() > 0
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and len(found) > 100


@pytest.mark.parametrize("gone", [["querywright/llm", "tests/llm"], ["querywright/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_operators_of_training_data(tmp_path, gone):
    """The other queries stay; nothing else of the package needs that subpackage."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(x) for x in gone]))
    code = """
import importlib, pkgutil
import __spark_entry__ as entry, querywright
for m in pkgutil.walk_packages(querywright.__path__, "querywright."):
    importlib.import_module(m.name)
found = entry.queries()
assert set(entry.oracle_sql()) <= set(found)
print(len(found), sum(x.startswith("op") or x == "pipeline" for x in found))
"""
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert made.returncode == 0, made.stderr
    n, operators = map(int, made.stdout.split())
    assert n > 100 and operators == 0
