"""The operators run where the workers can only import what the driver sends them."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
for name in ("op3_prefix_tree_join", "op7_toxicity_chain", "op13_token_alignment"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split() == ["op3_prefix_tree_join", "200", "op7_toxicity_chain", "200", "op13_token_alignment", "200"]
