"""Where written state goes when a session names no folder."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
from unitlens.operators.sinks import shared_folder, written
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert shared_folder(spark) == shared_folder(spark)
assert written(spark.range(5), "five").count() == 5
spark.stop()
"""


def test_a_local_session_without_the_setting_gets_its_own_folder():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
