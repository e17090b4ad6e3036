import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOAD = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_core_loads_without_the_optional_subpackage(tmp_path, pipeline_too):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    at = tmp_path / "repo" / "corpus_pipeline.py"
    if pipeline_too and at.exists():
        at.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LOAD], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    core, optional = map(int, out.stdout.split())
    assert core > 40 and optional == 0
