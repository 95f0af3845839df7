"""What a stream costs that brings much at once."""

import glob

from pyspark.sql import functions as F

from taskloom import model as M
from taskloom.sources import files
from taskloom.streaming import ingest
from taskloom.streaming.state import Recent


def test_envelopes_are_not_shuffled_where_none_is_dropped(spark):
    good = spark.range(2000).selectExpr("CASE WHEN id % 10 > 0 THEN concat('w', id) END AS id", "timestamp_seconds(100) AS received", "id AS place", "array(id) AS events")
    earlier = spark.createDataFrame([("w1", 0), ("other", 100)], "id string, at long").selectExpr("id", "timestamp_seconds(at) AS received")
    out = ingest.let_in(good, earlier)
    assert out.count() == 2000
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    # one second after it was let in, and ten
    again = spark.createDataFrame([("w1", 99), ("w2", 90)], "id string, at long").selectExpr("id", "timestamp_seconds(at) AS received")
    assert {r["place"] for r in ingest.let_in(good, again).collect()} == set(range(2000)) - {1}


def test_ids_of_one_hour_are_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        kept = Recent(spark, f"file://{tmp_path}/admitted", "id string, received timestamp", 10)
        rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.timestamp_seconds(F.lit(7200)).alias("received"))
        kept.put(rows, F.lit(2), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{tmp_path}/admitted/hour=2/batch=0/*.parquet")) > 1
    assert kept.before(1).distinct().count() == 40_000


def test_an_empty_table_costs_no_job(spark):
    none = files.empty(spark, M.TASK)
    assert none.schema == M.TASK or [(f.name, f.dataType) for f in none.schema] == [(f.name, f.dataType) for f in M.TASK]
    left = spark.range(10).select(F.col("id").cast("string").alias("task_id"))
    assert "Join" not in left.join(none, "task_id", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
