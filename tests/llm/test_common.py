import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from candor.llm import common


def test_sized_broadcast(spark):
    df = spark.range(100)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(common.sized_broadcast(df, 8)) and "broadcast" not in plan(common.sized_broadcast(df, 8, limit=100))
    assert "broadcast" not in plan(common.sized_broadcast(df, 8, F.col("id") * 100, limit=10_000))


def test_computed_is_not_merged_and_replaces(spark):
    df = spark.createDataFrame([(1, "a")], "id int, X string")
    out = common.computed(df, x=F.upper("X"), y=F.col("id") + 1)
    assert [tuple(r) for r in out.filter("y = 2").collect()] == [(1, "A", 2)]
    assert common.fresh(["a", "A_"], "A") == "A__"


def test_without_a_checkpoint_setting():
    code = """
from pyspark.sql import SparkSession
from candor.llm import common, simhash
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x")], "doc_id long, text string")
print("GOT", simhash.drop_duplicates(docs).count(), common.shared_dir(spark) == common.shared_dir(spark))
"""
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert "GOT 2 True" in said.stdout, said.stderr[-2000:]
