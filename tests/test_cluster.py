"""What only fails where executors are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

SHIPPED = """
import tempfile
from pyspark.sql import SparkSession
from marquetry.operators import model as M
from marquetry.operators.score import predict_proba

spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.executor.memory", "512m").getOrCreate()
folder = tempfile.mkdtemp(prefix="model-")
M.write_lookup_model(folder, {"kind": "hashed", "hashes": 1, "buckets": 2, "block": 8}, [-9.0, 9.0])
docs = spark.createDataFrame([("ab",)], "text string")
print([round(p) for p in predict_proba(docs, M.ModelScorer(M.ship(spark, folder))).first()["probs"]])
"""


def test_models_reach_executors(tmp_path):
    pytest.importorskip("onnxruntime")
    import pyspark

    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": os.path.dirname(pyspark.__file__), "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(tmp_path), "SPARK_LOCAL_DIRS": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SHIPPED], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().splitlines()[-1:] == ["[0, 1]"], done.stderr[-2000:]
