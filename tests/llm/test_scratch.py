import os
import subprocess
import sys

#: A session without ``spark.checkpoint.dir``: an empty folder of Spark's settings, so that this machine's defaults don't count.
RUN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from tidemark.llm.scratch import shared_dir
from tidemark.llm.sharding import sharded
docs = spark.createDataFrame([(i, "text " * (i % 7), "src") for i in range(50)], "doc_id long, text string, source string")
assert sharded(docs, shards=4).count() == 50
assert shared_dir(spark) == shared_dir(spark) and spark.conf.get("spark.checkpoint.dir", None) is None
print("done")
"""


def test_without_a_checkpoint_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    out = subprocess.run([sys.executable, "-c", RUN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "done" in out.stdout, out.stderr[-2000:]
