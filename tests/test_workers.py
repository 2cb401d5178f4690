"""Workers that do not have this package on their path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as contract
for name in ("topk_similar", "report_business"):
    assert contract.queries()[name](spark, {sf_dir!r}).count() > 0
print("fine")
"""


def test_python_work_needs_no_installation(sf_dir, tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, sf_dir=sf_dir)],
        cwd=tmp_path,
        env=bare,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]
