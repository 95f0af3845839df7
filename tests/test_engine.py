"""Cleaning, the store, adoption across batches, streaming and the client."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from test_fold import event

from taskloom import model as M
from taskloom.functions import normalize as N
from taskloom.operators import admission, hierarchy, lifecycle, plugins
from taskloom.sources import files
from taskloom.sources.client import FileSink, MemorySink, Params, StatisticsSink, Tracer
from taskloom.sources.store import TaskStore
from taskloom.streaming import ingest



def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def test_normalize(spark):
    rows = [event("a_task2_task2", 1, M.START, 0, "a", strings={"a.b": "1", "a_b": "x" * 9000}, metrics={"n": float("nan")}), event(None, 2, M.INFO, 0)]
    out = N.normalize(spark.createDataFrame(rows, M.EVENT)).collect()
    assert len(out) == 1 and out[0]["task_id"] == "a" and out[0]["context"] == {}
    assert len(out[0]["strings"]["a_b"]) == 8000 and out[0]["metrics"] == {"n": 0.0}


def test_rate_limit_keeps_the_first(spark):
    rows = [event(f"a___{i}", i, M.SPOT, 0, "a", status=M.SUCCESS) for i in range(51)]
    kept = admission.rate_limited(spark.createDataFrame(rows, M.EVENT), 50)
    assert sorted(r["seq"] for r in kept.collect()) == list(range(50))


def test_cycles_and_missing_parents_are_orphans(spark):
    nodes = spark.createDataFrame([("r", None, "R"), ("a", "r", "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "gone", "Z"), ("zz", "z", "ZZ"), ("s", "s", "S")], "task_id string, parent_id string, name string").withColumn("ctx", F.create_map(F.col("task_id"), F.lit("1")))
    out = {r["task_id"]: r for r in hierarchy.resolve(nodes).collect()}
    assert out["b"]["parents_path"] == ["R", "A"] and out["b"]["primary_id"] == "r" and out["b"]["ctx"] == {"r": "1", "a": "1", "b": "1"}
    assert out["r"]["parents_path"] is None and out["r"]["primary_id"] == "r"
    assert {k for k, r in out.items() if r["orphan"]} == {"x", "y", "z", "zz", "s"}


def test_deep_chain(spark):
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(200)], "task_id string, parent_id string, name string").withColumn("ctx", F.create_map(F.lit("k"), F.col("task_id")))
    out = {r["task_id"]: r for r in hierarchy.resolve(nodes).collect()}
    assert out["199"]["parents_path"] == [f"n{i}" for i in range(199)] and out["199"]["depth"] == 199 and out["199"]["ctx"] == {"k": "199"}


def test_store_split_batches_and_adoption(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=4)
    put = lambda *rows: ingest.ingest_batch(store, spark.createDataFrame(list(rows), M.EVENT), now=now())
    get = lambda: {r["task_id"]: r for r in store.tasks().collect()}
    put(event("c___1", 1, M.START, 5, "c", "b___1"), event("d___1", 2, M.START, 6, "d", "c___1"), event("e___1", 3, M.SUCCESS_EVENT, 9))
    t = get()
    assert t["c___1"]["orphan"] and t["d___1"]["orphan"] and t["e___1"]["status"] == M.PARTIAL_SUCCESS
    put(event("b___1", 10, M.START, 1, "b", "a___1"), event("c___1", 11, M.SUCCESS_EVENT, 8))
    assert get()["c___1"]["status"] == M.SUCCESS and get()["c___1"]["orphan"]
    put(event("a___1", 20, M.START, 0, "a"), event("e___1", 21, M.START, 4, "e"))
    t = get()
    assert t["d___1"]["parents_path"] == ["a", "b", "c"] and t["d___1"]["primary_id"] == "a___1" and t["d___1"]["orphan"] is False
    assert t["e___1"]["status"] == M.SUCCESS and t["e___1"]["duration"] == 5000
    put(event("f___1", 30, M.START, 7, "f", "d___1"))
    assert get()["f___1"]["parents_path"] == ["a", "b", "c", "d"] and get()["f___1"]["primary_id"] == "a___1"
    assert len(get()) == 6
    # the same version again replaces the batch
    v = store._versions()[-1]
    ingest.ingest_batch(store, spark.createDataFrame([event("f___1", 30, M.START, 7, "f", "d___1")], M.EVENT), now=now(), version=v)
    assert len(get()) == 6 and get()["f___1"]["status"] == M.UNTERMINATED


def test_generations(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    put = lambda *rows: ingest.ingest_batch(store, spark.createDataFrame(list(rows), M.EVENT), now=now())
    put(event("a___1", 1, M.START, 0, "a"), event("z___1", 2, M.START, 0, "z"))
    assert store.roll_over() == 2
    put(event("a___1", 3, M.SUCCESS_EVENT, 3), event("b___1", 4, M.START, 1, "b"))
    t = {r["task_id"]: r for r in store.tasks().collect()}
    assert t["a___1"]["generation"] == 1 and t["a___1"]["status"] == M.SUCCESS and t["b___1"]["generation"] == 2
    store.merge_generations(now())
    assert store.tasks().count() == 3
    store.expire(F.lit("2030-01-01").cast("timestamp"))
    assert store.tasks().count() == 0
    assert store.vacuum(1)


def test_merge_generations_unites_parts(spark):
    from taskloom.operators.fold import fold

    old = fold(spark.createDataFrame([event("a___1", 1, M.START, 0, "a", strings={"s": "1"})], M.EVENT), now())
    new = fold(spark.createDataFrame([event("a___1", 2, M.SUCCESS_EVENT, 3, strings={"t": "2"}), event("b___1", 3, M.INFO, 3)], M.EVENT), now())
    current, rest = lifecycle.merge_generations(new, old, now())
    t = {r["task_id"]: r for r in current.collect()}
    assert rest.count() == 0 and t["a___1"]["status"] == M.SUCCESS and t["a___1"]["string"] == {"s": "1", "t": "2"} and t["b___1"]["status"] == M.PARTIAL_INFO
    assert lifecycle.mergeable({1: 5, 2: 5, 3: 500, 4: 5}, {4}, 1000) == [(1, 2)]


def test_failing_plugin_is_reported(spark):
    class Broken:
        name = "broken"

        def apply(self, events):
            raise ValueError("no")

    e = spark.createDataFrame([event("a___1", 1, M.START, 0, "a")], M.EVENT)
    out, reports = plugins.run_all(e, [Broken(), *plugins.from_json('[{"class": "x.SwitchCase", "searchField": "t", "outputAttribute": "o", "switch": []}]')])
    assert out.count() == 1 and [r["status"] for r in reports] == ["ERROR", "SUCCESS"] and reports[1]["name"] == "SwitchCase_0"


def test_envelopes(spark):
    good = json.dumps({"id": "w", "events": [{"@type": "StartEvent", "taskId": "a", "time": "2024-01-01T02:00:00+02:00", "other": 1}]})
    lines = spark.createDataFrame([(0, good), (1, '[{"@type":"InfoEvent","taskId":"b"}]'), (2, "{broken"), (3, '{"id": "x"}')], "seq_base long, value string")
    e = files.envelopes_from_text(lines)
    assert e.filter("malformed IS NOT NULL").count() == 2
    out = {r["task_id"]: r for r in files.events_of(e).collect()}
    assert out["a"]["time"] == dt.datetime(2024, 1, 1) and out["b"]["seq"] == 1_000_000


def test_client_to_stream_to_store(spark, tmp_path):
    sink = FileSink(str(tmp_path / "in"))
    tracer = Tracer(StatisticsSink(sink), static={"host": "h"})
    with tracer.task("outer", Params().add_context("user", 7)):
        with pytest.raises(KeyError), tracer.task("inner"):
            tracer.metric("m", 2)
            raise KeyError("k")
        tracer.spot("ping")
    tracer.string("lost", 1)
    tracer.heartbeat(tracer.sink)
    tracer.sink.close()
    (tmp_path / "in" / "bad.json").write_text("nonsense\n")
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    q = ingest.stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/check", dead=f"file://{tmp_path}/dead")
    q.awaitTermination(120)
    assert q.exception() is None
    t = {r["name"]: r for r in store.tasks().collect()}
    assert t["outer"]["status"] == M.SUCCESS and t["inner"]["status"] == M.ERROR and t["inner"]["parents_path"] == ["outer"] and t["inner"]["ctx"] == {"user": "7"}
    assert t["ping"]["primary_id"] == t["outer"]["task_id"] and t[M.NO_CONTEXT]["status"] == M.CORRUPTED and M.HEARTBEAT not in t
    assert spark.read.json(f"file://{tmp_path}/dead/*").count() == 1
    assert any(f.endswith(".json.gz") for f in os.listdir(tmp_path / "in"))


def test_client_stack():
    sink = MemorySink()
    tracer = Tracer(sink)
    a = tracer.start("a")
    tracer.for_task(a).start_child("b").success()

    @tracer.traced(log_arguments=True)
    def f(x):
        return x + 1

    assert tracer.carried(f)(1) == 2
    tracer.success()
    assert tracer.success() is None
    kinds = [e["@type"] for e in sink.events]
    assert kinds == [M.START, M.START, M.SUCCESS_EVENT, M.START, M.SUCCESS_EVENT, M.SUCCESS_EVENT, M.SPOT]
    assert sink.events[1]["parentId"] == a == sink.events[3]["parentId"] and sink.events[3]["strings"] == {"arg0": "1"}


def test_equal_ids_in_two_environments(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    rows = [event("x___1", 1, M.START, 0, "x") | {"env": e} for e in ("a", "b")] + [event("y___1", 2, M.START, 1, "y", "x___1") | {"env": e} for e in ("a", "b")]
    ingest.ingest_batch(store, spark.createDataFrame([r for r in rows if not (r["env"] == "b" and r["task_id"] == "x___1")], M.EVENT), now=now())
    t = {(r["env"], r["task_id"]): r for r in store.tasks().collect()}
    assert len(t) == 3 and t["a", "y___1"]["primary_id"] == "x___1" and t["b", "y___1"]["orphan"]
    ingest.ingest_batch(store, spark.createDataFrame([rows[1]], M.EVENT), now=now(), reports=f"file://{tmp_path}/reports")
    out = store.tasks().collect()
    t = {(r["env"], r["task_id"]): r for r in out}
    assert len(out) == 4 and t["b", "y___1"]["parents_path"] == ["x"] and t["b", "y___1"]["orphan"] is False
    assert spark.read.json(f"file://{tmp_path}/reports/batches").first()["events_amount"] == 1


def test_a_sink_does_not_wait_for_the_next_event(tmp_path):
    import time

    sink = FileSink(str(tmp_path), max_seconds=0.1)
    Tracer(sink).spot("a")
    time.sleep(0.5)
    assert len([f for f in os.listdir(tmp_path) if f.endswith(".json.gz")]) == 1 and not sink.held


def test_projection_of_single_keys(spark):
    from taskloom.operators import lookup

    t = spark.range(1).select(F.col("id").alias("task_id"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("ctx"), F.create_map(F.lit("c"), F.lit("3")).alias("string"))
    assert lookup.fields(t, exclude=["ctx.a", "string.*"]).first().asDict() == {"task_id": 0, "ctx": {"b": "2"}}
    assert lookup.fields(t, ["task_id", "ctx.b"]).first().asDict() == {"task_id": 0, "ctx.b": "2"}


def test_an_outage_is_no_fault_of_a_plugin(spark):
    class Outage:
        name = "outage"

        def apply(self, events):
            raise OSError("no space left")

    with pytest.raises(OSError):
        plugins.run_all(spark.createDataFrame([event("a___1", 1, M.START, 0, "a")], M.EVENT), [Outage()])
