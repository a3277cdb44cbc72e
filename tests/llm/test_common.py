import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
from pyspark.sql import SparkSession
from tecflow.llm.common import shared_dir, staged
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = shared_dir(spark)
assert staged(spark.range(3), "x").count() == 3 and shared_dir(spark) == first
print("fine")
"""


def test_a_session_without_a_configured_folder(tmp_path):
    """In a process of its own: the first staged table of a local session works where nothing names a folder."""
    top = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{top}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], capture_output=True, text=True, env=env, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
