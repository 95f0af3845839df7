"""What travels through the tree's rounds: nodes with children, and ids alone where a batch looks for those below it."""

from pyspark.sql import functions as F
from test_engine import now
from test_fold import event

from taskloom import model as M
from taskloom.operators import hierarchy
from taskloom.sources import files
from taskloom.streaming import ingest


def recorded(monkeypatch, module):
    seen, plain = [], files.stored

    def stored(df, tag):
        out = plain(df, tag)
        seen.append((tag, out.count(), out.columns))
        return out

    monkeypatch.setattr(module, "stored", stored)
    return seen


def test_only_nodes_with_children_are_doubled(spark, monkeypatch):
    seen = recorded(monkeypatch, hierarchy)
    rows = [("r", None, None), ("a", "r", "A"), *((f"l{i}", "a", "L") for i in range(50)), *((f"m{i}", "gone", "M") for i in range(50)), *((f"q{i}", None, "Q") for i in range(50))]
    nodes = spark.createDataFrame(rows, "task_id string, parent_id string, name string").withColumn("ctx", F.create_map(F.col("task_id"), F.lit("1"))).withColumn("mark", F.col("task_id"))
    out = {r["task_id"]: r for r in hierarchy.resolve(nodes, carried=("mark",)).collect()}
    assert len(out) == 152 and all(r["mark"] == k for k, r in out.items())
    assert seen and max(n for _, n, _ in seen) == 2
    # a parent without a name lends its context all the same
    assert out["l7"]["ctx"] == {"r": "1", "a": "1", "l7": "1"} and out["l7"]["parents_path"] == [None, "A"] and out["l7"]["depth"] == 2
    assert {k for k, r in out.items() if r["orphan"]} == {f"m{i}" for i in range(50)}
    assert out["q3"]["primary_id"] == "q3" and out["q3"]["parents_path"] is None


def test_a_batch_finds_what_is_below_it_by_ids(spark, monkeypatch, tmp_path):
    from taskloom.sources.store import TaskStore

    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    put = lambda *rows: ingest.ingest_batch(store, spark.createDataFrame(list(rows), M.EVENT), now=now())
    put(event("b___1", 1, M.START, 1, "b", "a___1"), event("c___1", 2, M.START, 2, "c", "b___1"), event("d___1", 3, M.START, 3, "d", "c___1"), event("z___1", 4, M.START, 3, "z", "y___1"))
    seen = recorded(monkeypatch, files)
    # the batch brings a part of one waiting task along with their parent
    put(event("a___1", 10, M.START, 0, "a"), event("c___1", 11, M.SUCCESS_EVENT, 9))
    levels = [(n, columns) for tag, n, columns in seen if tag == "below"]
    assert [n for n, _ in levels] == [4, 3, 2, 1] and all(set(c) == {"node", "up", "met"} for _, c in levels)
    out = {r["task_id"]: r for r in store.tasks().collect()}
    assert {k: r["parents_path"] for k, r in out.items() if not r["orphan"]} == {"a___1": None, "b___1": ["a"], "c___1": ["a", "b"], "d___1": ["a", "b", "c"]}
    assert out["c___1"]["status"] == M.SUCCESS and out["b___1"]["primary_id"] == "a___1" and out["z___1"]["orphan"]
