"""User functions must reach the workers although the package is not installed there."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
for name in ("process_pages", "process_batches", "annotate_documents", "image_metrics", "page_range_udtf"):
    assert entry.queries()[name](spark, {root!r}).count() > 0, name
print("all ran")
"""


def test_functions_run_from_another_folder(root, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, root=root)],
        cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False,
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]
