"""The store: what a lookup reads, what waits for parents, and many parts."""

from pyspark.sql import functions as F
from test_engine import now
from test_fold import event

from taskloom import model as M
from taskloom.sources.store import TaskStore
from taskloom.streaming import ingest


def plain_tasks(spark, first, n):
    has = {"env": F.lit("default"), "task_id": F.concat(F.lit("t___"), F.col("id").cast("string")), "name": F.lit("t"), "status": F.lit(M.UNTERMINATED), "task_begin": now(), "ctx": F.create_map(F.lit("n"), F.col("id").cast("string"))}
    return spark.range(first, first + n).select(*[has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.TASK])


def rows_scanned(df):
    """(rows that come out of the scans of files, rows of the result)."""
    n = len(df.collect())
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            total += p.metrics().apply("numOutputRows").value()
        else:
            c = p.children()
            todo += [c.apply(i) for i in range(c.size())]
    return total, n


def test_a_lookup_reads_pages_and_not_the_table(spark, tmp_path):
    read = []
    for size in (4_000, 40_000):
        store = TaskStore(spark, f"file://{tmp_path}/{size}", buckets=8, page_rows=50)
        store._write(plain_tasks(spark, 0, size).withColumns({"batch": F.lit(0).cast("long"), "slot": store._slot(F.xxhash64("env", "task_id"))}).repartition(8, "slot"), "base/generation=1/version=1", "slot")
        store._write(plain_tasks(spark, size, 500).withColumns({"batch": F.lit(1).cast("long"), "generation": F.lit(1)}).coalesce(1), "parts/version=2", "generation")
        ids = plain_tasks(spark, 0, 40).select("env", "task_id").unionByName(plain_tasks(spark, size + 10**6, 5).select("env", "task_id"))
        base, parts = store.found(ids)
        some, n = rows_scanned(store._near(store.rows()[0], ids, True))
        assert base.count() == 40 and parts.count() == 0 and n >= 40
        read.append(some)
        # the slots of many ids
        many = plain_tasks(spark, 0, 3000).select("env", "task_id")
        assert store.found(many)[0].count() == 3000
        task = store.tasks(ids=ids).filter("task_id = 't___7'").first()
        assert task["ctx"] == {"n": "7"} and task["generation"] == 1
    # a page an id at most (and the ids asked), though the table has ten times the rows
    assert read[1] <= 45 * 50 + 45 and read[1] <= 2 * read[0]


def test_waiting_tasks_are_kept_apart(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=4)
    put = lambda *rows: ingest.ingest_batch(store, spark.createDataFrame(list(rows), M.EVENT), now=now())
    waiting = lambda: {r["task_id"]: r["status"] for r in store.orphans().collect()}
    put(event("b___1", 1, M.START, 1, "b", "a___1"), event("c___1", 2, M.START, 2, "c", "b___1"), event("z___1", 3, M.START, 3, "z", "y___1"))
    assert waiting() == dict.fromkeys(("b___1", "c___1", "z___1"), M.UNTERMINATED)
    # a part of a waiting task, and one that is none
    put(event("z___1", 10, M.SUCCESS_EVENT, 9), event("q___1", 11, M.START, 9, "q"))
    assert waiting() == {"b___1": M.UNTERMINATED, "c___1": M.UNTERMINATED, "z___1": M.SUCCESS}
    store.compact()
    assert len(waiting()) == 3
    put(event("a___1", 20, M.START, 0, "a"))
    assert waiting() == {"z___1": M.SUCCESS}
    # a batch that is written again starts from what waited before it
    v = store._versions()[-1]
    ingest.ingest_batch(store, spark.createDataFrame([event("y___1", 20, M.START, 0, "y")], M.EVENT), now=now(), version=v)
    assert set(waiting()) == {"b___1", "c___1"}
    # what expires waits no more
    store.expire(F.lit("2030-01-01").cast("timestamp"))
    assert waiting() == {} and store.tasks().count() == 0


def test_few_parts_stay(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    for i in range(5):
        store.append(plain_tasks(spark, 10 * i, 15), batch=i)
        store.tidy(2)
    assert len(store._versions()) <= 3 and store.tasks().count() == 55 and store.last_batch() == 4


def test_neighbours_that_fit_are_packed():
    from taskloom.operators.lifecycle import packed

    assert packed({1: 3, 2: 3, 3: 5, 4: 9, 5: 1, 6: 1}, {5}, 8) == [[1, 2], [3], [4], [5], [6]]
    assert packed({}, set(), 8) == [] and packed({1: 20, 2: 1, 4: 7}, set(), 8) == [[1], [2, 4]]
