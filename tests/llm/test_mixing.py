"""The mixing query deals whole rows."""

import glob

from pyspark.sql import functions as F

from taskloom.llm.mixing import op1_mixing


def test_texts_travel(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    at = lambda: set(glob.glob(f"{folder.removeprefix('file://')}/mixing-rows-*"))
    before = at()
    out = op1_mixing(spark, "/root/testdata/sf0.001")
    keys = [r["order_key"] for r in out.collect()]
    assert keys == sorted(keys)
    (path,) = at() - before
    mixed = spark.read.parquet(f"file://{path}")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("wanted"))
    assert mixed.count() == len(keys) == mixed.join(texts, "doc_id").filter("text <=> wanted").count() > 0
