"""Operators on executors that have no copy of this library."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
import pyspark  # found before the library's folder is
from pyspark.sql import SparkSession

spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://" + sys.argv[2] + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("OFF")


def bare(batches):
    import importlib.util

    for batch in batches:
        yield batch.assign(there=importlib.util.find_spec("voxmend") is not None)


assert not spark.range(1).mapInPandas(bare, "id long, there boolean").first()["there"]
sys.path.insert(0, sys.argv[1])
from voxmend.llm import queries

for name, query in queries.QUERIES.items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
    print(name, flush=True)
"""


def test_operators_need_no_installed_copy(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), str(tmp_path)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 11
