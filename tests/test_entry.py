"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.conftest import ROOT

SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), set(o) <= set(q), 'pipeline' in q, any(n.startswith('op') for n in q))"


def shown(root: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=root, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_names():
    assert shown(ROOT)[2] == "True"


@pytest.mark.parametrize("left", ["nothing", "pipeline", "caches"])
def test_without_the_subpackage(tmp_path, left):
    """Both folders gone, with the pipeline beside them or not; compiled files may stay."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    shutil.rmtree(copy / "sparkloom" / "llm", ignore_errors=True)
    if left == "caches":
        (copy / "sparkloom" / "llm" / "__pycache__").mkdir(parents=True)
    if left == "nothing":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    n, m, inside, pipeline, operators = shown(copy)
    assert int(n) > 50 and int(m) > 40 and (inside, pipeline, operators) == ("True", "False", "False")


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["work_id", "title", "ppr", "degree", "score"] and got.count() == 20


def test_no_module_outside_imports_the_subpackage():
    for path in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sparkloom.llm" not in path.read_text(), path
