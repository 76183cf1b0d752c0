import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ENV = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}


def test_names_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "scorewright", tmp_path / "scorewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'basic_reward' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=ENV)


def test_entry_runs_elsewhere(tmp_path, spark):
    """A driver that has the repository on its own path only: the executors get the package shipped."""
    ORDERS = tmp_path
    spark.createDataFrame([(i, 10.25 * i) for i in range(6)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["accuracy_reward"](spark, {str(ORDERS)!r}).where("reward = 1").count() == 4
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=ENV, timeout=200)
