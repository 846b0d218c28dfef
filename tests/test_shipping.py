import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.entry(spark).count(), __spark_entry__.queries()["chunk_documents"](spark, __spark_entry__.SMALL).count())
"""


def test_workers_find_the_package_from_anywhere(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
