import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
from tidemark.session import ship
from tidemark.sources.pgoutput import decode
ship(spark)
ship(spark)
df = spark.createDataFrame([(bytearray(b"X"),)], "data binary")
print("FOUND", decode(df, "data", errors="null").first()["error"])
"""


def test_workers_that_start_elsewhere_have_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "FOUND message of kind 'X'" in out.stdout, out.stderr[-2000:]
