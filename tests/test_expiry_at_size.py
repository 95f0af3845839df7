"""What expiry and compaction cost as generations grow."""

import glob

from pyspark.sql import functions as F

from taskloom import model as M
from taskloom.sources import store as S


def tasks(spark, n, **more):
    cols = {"env": F.lit("e"), "task_id": F.concat(F.lit("t"), F.col("id").cast("string")), "status": F.lit(M.SUCCESS), "name": F.lit("x"), **more}
    return spark.range(n).select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.TASK])


def test_a_large_slot_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 100)
    store = S.TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    store.append(tasks(spark, 2000), new=True)
    version = store.compact()
    for slot in (0, 1):
        found = glob.glob(f"{tmp_path}/store/base/generation=1/version={version}/slot={slot}/*.parquet")
        assert len(found) >= 4
        # their hashes do not overlap, so an id is looked for in one of them
        ends = sorted(spark.read.parquet(f"file://{f}").agg(F.min("h"), F.max("h")).first() for f in found)
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert store.tasks().count() == 2000
    assert store.tasks(ids=tasks(spark, 5)).count() == 5


def test_expiry_reads_only_what_decides(spark, tmp_path, monkeypatch):
    seen, plain = [], S.lifecycle.expired_by_generation

    def spied(tasks, now, top):
        seen.append(tasks.columns)
        return plain(tasks, now, top)

    monkeypatch.setattr(S.lifecycle, "expired_by_generation", spied)
    store = S.TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    at = lambda day: F.expr(f"make_timestamp(2024, 1, {day}, 0, 0, 0)")
    store.append(tasks(spark, 30, status=F.lit(M.PARTIAL_SUCCESS), date_to_delete=at(2)))
    # a later part moves the date while the stored task is a part
    store.append(tasks(spark, 10, status=F.lit(M.UNTERMINATED), date_to_delete=at(9)))
    store.expire(F.expr("make_timestamp(2024, 1, 5, 0, 0, 0)"))
    assert seen == [["env", "task_id", "status", "task_begin", "task_end", "date_to_delete", "generation"]]
    left = store.tasks().collect()
    assert {r["task_id"] for r in left} == {f"t{i}" for i in range(10)} and {r["status"] for r in left} == {M.SUCCESS}
