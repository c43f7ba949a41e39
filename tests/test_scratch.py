import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshnet.plans import scratch

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from meshnet.operators import pca, vqpca
df = spark.range(40).select(F.col("id").alias("cell_id"), F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0).alias("features"))
model = pca.fit_pca(df, level=1.0)
print("ROWS", vqpca.assign(df, {{0: model}}).count())
"""


def test_package_reaches_workers_from_any_folder(tmp_path):
    out = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, capture_output=True, text=True, timeout=240, check=False)
    assert "ROWS 40" in out.stdout, out.stderr[-2000:]


def test_materialize(spark):
    df = spark.range(10).withColumn("half", F.floor(F.col("id") / 5).cast("int"))
    back = scratch.materialize(df, "test", ["half"])
    assert sorted(map(tuple, back.select("id", "half").collect())) == sorted(map(tuple, df.collect()))
    assert back.inputFiles()[0].startswith(scratch.shared_dir(spark))
    assert scratch.new_path(spark, "a") != scratch.new_path(spark, "a")


def test_batch_bound(spark):
    scratch.bound_arrow_batches(spark, 1 << 20)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(1 << 20)
    scratch.bound_arrow_batches(spark, 1 << 24)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(1 << 20)
    with pytest.raises(Exception):  # noqa: B017
        spark.conf.get("spark.no.such.setting")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
