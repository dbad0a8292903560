"""The driver's entry points, also without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from conftest import ROOT


def test_sql_belongs_to_queries(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_stands_without_the_subpackage(tmp_path):
    def ignore(folder, names):
        return [n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")]

    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-2000:]
