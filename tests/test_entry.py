"""The entry points with and without the training-data subpackage."""

import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("missing", ["quire.llm", "corpus_pipeline"])
def test_entry_works_without_the_subpackage(missing):
    out = run(f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(any(n.startswith('op') for n in e.queries()), len(e.queries()) > 50, set(e.oracle_sql()) <= set(e.queries()))")
    assert out.returncode == 0 and out.stdout.split()[1:] == ["True", "True"] and "pipeline" not in out.stdout, out.stderr


@pytest.mark.skipif(importlib.util.find_spec("quire.llm") is None, reason="the subpackage is not there")
def test_a_package_that_is_absent_costs_its_own_queries_only():
    out = run("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()) > 100, 'op7_simhash' in e.queries())")
    assert out.returncode == 0 and out.stdout.split() == ["True", "False"] and "xxhash" in out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "quire")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "quire.llm" not in f.read(), name


def test_the_rest_works_when_the_folders_are_gone(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports, lists its queries and runs one."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); print(any(n.startswith('op') or n == 'pipeline' for n in q), len(q) > 100, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split() == ["False", "True", "True"], out.stderr
    tests = subprocess.run(
        [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_sources.py", "tests/test_functions.py"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=600
    )
    assert tests.returncode == 0, tests.stdout[-2000:]
