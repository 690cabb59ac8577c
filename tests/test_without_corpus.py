"""A copy of the repository without the corpus folders registers all other queries."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as E
import tabscope
assert tabscope.__file__.startswith({root!r}), tabscope.__file__
q, o = E.queries(), E.oracle_sql()
assert set(q) == set(E._queries()) and set(o) == set(E._oracle()) and "pipeline" not in q
assert not any(k.startswith("op") and k[2].isdigit() for k in q)
print(len(q))
"""


@pytest.mark.parametrize("also_pipeline", [False, True])
def test_entry_without_the_corpus_folders(tmp_path, also_pipeline):
    gone = {"llm", ".git", "__pycache__", "spark-warehouse"} | ({"corpus_pipeline.py"} if also_pipeline else set())
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: gone & set(names))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT.format(root=copy)], cwd=copy, env=env, capture_output=True,
                         text=True, timeout=300)
    assert res.returncode == 0, res.stderr[-2000:]
