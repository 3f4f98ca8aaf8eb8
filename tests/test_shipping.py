"""A session started from another folder, without a search path: Python workers still find the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as entry
frame = entry.queries()["shapley_fixed_trees"](spark, sys.argv[1])
print("rows", frame.count(), "sent", sum("riskloom-" in f for f in spark.sparkContext.listFiles))
entry.queries()["flags"](spark, sys.argv[1])
print("archives", sum("riskloom-" in f for f in spark.sparkContext.listFiles))
"""


def test_workers_import_the_package(small_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, small_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split("\n")[0].startswith("rows ") and "rows 0 " not in done.stdout
    assert "archives 1" in done.stdout
