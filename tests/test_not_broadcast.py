"""Tables that grow with the data meet by shuffles, also where their files are small."""

from pyspark.sql import functions as F

from taskloom.sources import files
from taskloom.streaming import ingest


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_with_large_files_is_not_broadcast(spark):
    # 2 MB of files, under Spark's own bound of 10 MB
    ids = files.stored(spark.range(250_000).select(F.xxhash64("id").alias("a")), "test-ids")
    assert files.LARGE < ids.stored_bytes < 10 << 20
    rows = spark.range(1000).select(F.xxhash64("id").alias("a"))
    assert "SortMergeJoin" in plan_of(rows.join(files.kept_apart(ids, ids), "a", "left_semi"))
    few = files.stored(ids.limit(10), "test-few")
    assert "BroadcastHashJoin" in plan_of(ids.join(files.kept_apart(few, few), "a", "left_semi"))


def test_envelopes_let_in_do_not_pass_through_the_driver(spark):
    good = spark.range(2000).selectExpr("concat('w', id % 1500) AS id", "timestamp_seconds(0) AS received", "id AS place")
    earlier = spark.createDataFrame([], "id string, received timestamp")
    out = ingest.let_in(good, earlier)
    assert "SortMergeJoin" in plan_of(out.select("place")) and out.count() == 1500


def test_open_batches_do_not_pass_through_the_driver(spark, monkeypatch):
    from taskloom.operators import batches

    seen, plain = [], batches.stored

    def stored(df, tag):
        seen.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return plain(df, tag)

    monkeypatch.setattr(batches, "stored", stored)
    rows = spark.range(400).selectExpr("id AS seq", "'q' AS queue", "timestamp_seconds(id) AS time")
    out = batches.by_size(rows, 30, F.lit(10), "queue", slice_rows=32)
    rounds = [p for tag, p in seen if tag in ("slices-met", "slices-jumps")]
    assert len(rounds) > 4 and all("strategy=merge" in p for p in rounds)
    assert {r["seq"]: r["batch"] for r in out.select("seq", "batch").collect()} == {i: i // 4 for i in range(400)}
