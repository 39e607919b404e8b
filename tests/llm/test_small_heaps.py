"""What the pipeline asks of its session: little heap for each task, and no path that workers would have to share."""

import os
import subprocess
import sys

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kindred.llm import common

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ELSEWHERE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int").write.parquet("labels.parquet")
docs = spark.createDataFrame([(i, "word " * (i + 1) + "#" * (i % 2 * 40)) for i in range(9)], "doc_id long, text string")
docs.write.parquet("documents.parquet")
print("rows", corpus_pipeline.quality_classifier(spark, docs, ".").count())
"""


def test_workers_need_not_have_the_package_on_their_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", ELSEWHERE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows " in ran.stdout, ran.stderr[-2000:]


def test_written_tables_have_small_row_groups(spark):
    letters = np.random.default_rng(0).integers(97, 123, 50_000, dtype=np.uint8).tobytes().decode()
    df = spark.range(0, 1_200, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.lit(letters)).alias("text"))  # 60 MB in one task
    at = common.written(df, "wide").written_to.removeprefix("file:")
    files = [f"{at}/{x}" for x in os.listdir(at) if x.endswith(".parquet")]
    sizes = [m.row_group(i).total_byte_size for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
    assert sum(sizes) > 50e6 and max(sizes) < 1.5 * common.GROUP_BYTES
