"""The entry points stand without the training-data subpackage, whichever of its parts is gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') or n == 'pipeline' for n in q), len(set(o) - set(q)))"


def asked(where):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=where, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [int(x) for x in out.stdout.split()]


@pytest.mark.parametrize("gone", [["plantables/llm", "tests/llm"], ["plantables/llm", "tests/llm", "corpus_pipeline.py"], ["plantables/llm/common.py"]])
def test_entry_without_training_data_parts(tmp_path, gone):
    from plantables.plans import registry

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    assert asked(copy) == [len(registry.QUERIES), len(registry.ORACLE_SQL), 0, 0]
