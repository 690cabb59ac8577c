"""Queries run in a fresh session whose working directory is outside the repo,
so Python workers cannot import the package from the current directory."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_python_udf_query_outside_repo(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        import __spark_entry__ as E
        assert E.entry(spark).count() > 0
        n = E.queries()["outliers_iforest"](spark, "/root/testdata/sf0.001").count()
        print("OK", n)
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    assert "OK" in res.stdout
