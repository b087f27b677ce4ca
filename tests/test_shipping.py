import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from sylvan.engine import Engine
df = spark.createDataFrame([("a.py", "def f(x):\\n    return g(x)\\n")], "file string, text string")
e = Engine.from_texts(spark, df, persist=False)
print("RESULT", e.sql("SELECT name FROM functions").collect()[0][0])
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "RESULT f" in done.stdout, done.stderr[-2000:]
