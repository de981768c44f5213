"""The Python-side operators run when executors cannot import the package."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__ as E
n = E.queries()["forecast_attention"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n)
"""


def test_forecast_runs_from_another_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(prefix="rentscope-cwd-"),
                         env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1].split()[0]) > 0


def test_entry_without_the_text_operators():
    """The reports are registered and import nothing of the text operators when those are not there."""
    import shutil

    root = tempfile.mkdtemp(prefix="rentscope-bare-")
    shutil.copy(f"{REPO}/__spark_entry__.py", root)
    shutil.copytree(f"{REPO}/rentscope", f"{root}/rentscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as E; from rentscope.registry import ORACLE, QUERIES; " \
           "print(E.queries().keys() == QUERIES.keys() and E.oracle_sql() == ORACLE)"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": root})
    assert out.stdout.strip() == "True", out.stderr[-2000:]
