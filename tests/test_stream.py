"""Streams whose files come late, out of order or with many envelopes."""

import json
import os

from pyspark.sql import functions as F

from taskloom import model as M
from taskloom.sources.store import TaskStore
from taskloom.streaming import ingest

T0 = 1_700_000_000


def put(folder, name, at, *lines):
    os.makedirs(folder, exist_ok=True)
    path = folder / f"{name}.tmp"
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    os.utime(path, (at, at))
    os.rename(path, folder / f"{name}.json")


def wrapped(event_id, task, kind=M.START, **more):
    return {"id": event_id, "events": [{"@type": kind, "taskId": task, "time": "2024-01-01T00:00:00Z", **more}]}


def run(spark, tmp_path, store):
    q = ingest.stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/check", dead=f"file://{tmp_path}/dead")
    q.awaitTermination(120)
    assert q.exception() is None
    return {r["task_id"]: r for r in store.tasks().collect()}


def test_late_files_lose_nothing(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    old = T0 - 30 * 86400
    put(tmp_path / "in", "a", T0, wrapped("w1", "a___1"), wrapped("w1", "x___1"))
    run(spark, tmp_path, store)
    # a month, and a minute, before what has been seen: new ids, no ids, malformed lines; and a duplicate of the first
    bare = json.dumps(wrapped(None, "c___1")["events"])
    put(tmp_path / "in", "b", old, wrapped("w2", "b___1"), bare, bare, "{broken", "{broken")
    put(tmp_path / "in", "c", T0 - 60, wrapped("w3", "d___1"), wrapped("w1", "e___1"))
    put(tmp_path / "in", "d", T0 - 5, wrapped("w1", "x___2"))
    put(tmp_path / "in", "e", T0 + 5, wrapped("w1", "x___3"))
    out = run(spark, tmp_path, store)
    assert sorted(out) == ["a___1", "b___1", "c___1", "d___1", "e___1"]
    assert spark.read.json(f"file://{tmp_path}/dead/*").count() == 2


def test_duplicates_go_by_the_last_one_let_in(spark):
    rows = [("w", 0, 0), ("w", 19, 1), ("w", 21, 2), ("w", 29, 3), ("v", 5, 4), (None, 0, 5), (None, 0, 6), ("w", 0, 7)]
    good = spark.createDataFrame(rows, "id string, s long, place long").selectExpr("id", "timestamp_seconds(s) AS received", "place")
    earlier = spark.createDataFrame([("v", 10), ("u", 5)], "id string, s long").selectExpr("id", "timestamp_seconds(s) AS received")
    assert sorted(r["place"] for r in ingest.let_in(good, earlier).collect()) == [0, 1, 3, 5, 6]


def test_files_far_apart_come_in_order(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    start = T0 - T0 % 1000 + 900
    # the later file has the lesser time within its 1000 seconds, and the lesser name
    put(tmp_path / "in", "b", start, wrapped("w1", "a___1", name="first", strings={"k": "1"}))
    put(tmp_path / "in", "a", start + 1100, wrapped("w2", "a___1", M.INFO, strings={"k": "2"}))
    task = run(spark, tmp_path, store)["a___1"]
    assert task["string"] == {"k": "2"} and task["name"] == "first"


def test_many_envelopes_of_a_file_keep_their_order(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    put(tmp_path / "in", "a", T0, wrapped("w", "a___1", name="a"), *[wrapped(f"w{i}", f"a___{i % 50}", M.INFO, strings={"k": str(i)}) for i in range(5000)], wrapped("v", "a___1", name="b"))
    put(tmp_path / "in", "b", T0, wrapped("u", "a___2", M.INFO, strings={"k": "last"}))
    out = run(spark, tmp_path, store)
    wanted = {f"a___{i}": str(4950 + i) for i in range(50)} | {"a___2": "last"}
    assert {t: r["string"]["k"] for t, r in out.items()} == wanted
    assert out["a___1"]["status"] == M.CORRUPTED and out["a___1"]["name"] == "a"


def test_a_limit_holds_over_batches(spark, tmp_path):
    found = []
    for files_per_batch in (100, 2):
        folder = tmp_path / str(files_per_batch)
        for i in range(6):
            put(folder / "in", f"f{i}", T0 + 60 * i, wrapped(f"w{i}", f"a___{i}", name="a"), wrapped(f"v{i}", f"b___{i}", name=f"b{i % 2}"))
        store = TaskStore(spark, f"file://{folder}/store", buckets=2)
        q = ingest.stream(spark, f"file://{folder}/in", store, f"file://{folder}/check", ingest.Settings(limit=2), files_per_batch=files_per_batch, parts=2)
        q.awaitTermination(300)
        assert q.exception() is None
        found.append(sorted(r["task_id"] for r in store.tasks().collect()))
        assert len(store._versions()) <= 3
    assert found[0] == found[1] == sorted(["a___0", "a___1", *(f"b___{i}" for i in range(4))])


def test_what_is_remembered_stays_small_and_late_envelopes_are_set_apart(spark, tmp_path):
    store, hour = TaskStore(spark, f"file://{tmp_path}/store", buckets=2), 3600
    settings = ingest.Settings(remembers=2)

    def run(**more):
        q = ingest.stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/check", settings, dead=f"file://{tmp_path}/dead", **more)
        q.awaitTermination(120)
        assert q.exception() is None

    for i in (0, 3, 5):
        put(tmp_path / "in", f"f{i}", T0 + i * hour, wrapped(f"w{i}", f"a___{i}"))
        run()
    assert len([x for x in os.listdir(tmp_path / "check" / "admitted") if x.startswith("hour=")]) == 2
    put(tmp_path / "in", "late", T0 - hour, wrapped("w0", "late___1"), json.dumps(wrapped(None, "late___2")["events"]))
    put(tmp_path / "in", "soon", T0 + 5 * hour + 5, wrapped("w5", "again___1"))
    run()
    assert sorted(r["task_id"] for r in store.tasks().collect()) == [*(f"a___{i}" for i in (0, 3, 5)), "late___2"]
    late = spark.read.json(f"file://{tmp_path}/check/late/*").collect()
    assert [r["id"] for r in late] == ["w0"] and late[0]["events"][0]["taskId"] == "late___1"


def test_generations_begin_in_the_stream(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    for i in range(4):
        put(tmp_path / "in", f"f{i}", T0 + i, wrapped(f"w{i}", f"a___{i}"), wrapped(f"v{i}", f"b___{i}"))
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    q = ingest.stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/check", ingest.Settings(most_rows=3), files_per_batch=1)
    q.awaitTermination(300)
    assert q.exception() is None
    assert {r["task_id"]: r["generation"] for r in store.tasks().collect()} == {f"{k}___{i}": 1 + i // 2 for k in "ab" for i in range(4)}
    # nothing that was stored on the way is left but what this test's own reads stored
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) - before
    assert not [x for x in left if not x.startswith(("asked", "found"))], left


def test_dead_letters_are_sent_again(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/store", buckets=2)
    dead, check = f"file://{tmp_path}/dead", f"file://{tmp_path}/check"
    broken = json.dumps(wrapped("w2", "b___1"))[:-1]  # lacks its last brace
    bare = json.dumps(wrapped(None, "c___1", M.SPOT)["events"])[:-1] + "}"
    put(tmp_path / "in", "a", T0, wrapped("w1", "a___1"), broken, broken, bare, "nonsense", "")
    mend = lambda line: F.when(F.startswith(line, F.lit("[")), F.concat(F.rtrim(line, F.lit("}")), F.lit("}]"))).when(F.startswith(line, F.lit("{")), F.concat(line, F.lit("}"))).otherwise(line)
    sent = lambda: ingest.send_again(spark, dead, check, mend)
    assert sorted(run(spark, tmp_path, store)) == ["a___1"]
    assert sent() == [0] and sent() == []
    # what was broken off is written anew, and so read twice
    os.rename(tmp_path / "check" / "again" / "batch=0" / "_SUCCESS", tmp_path / "check" / "again" / "gone")
    out = run(spark, tmp_path, store)
    assert sorted(out) == ["a___1", "b___1", "c___1"]
    assert sent() == [0, 1]
    assert sorted(run(spark, tmp_path, store)) == ["a___1", "b___1", "c___1"]
    rounds = 0
    while sent():
        out, rounds = run(spark, tmp_path, store), rounds + 1
    assert rounds == 1 and sorted(out) == ["a___1", "b___1", "c___1"] and out["b___1"]["status"] == M.UNTERMINATED
    letters = spark.read.json(f"{dead}/batch=*").collect()
    assert max(r["attempts"] for r in letters) == 3
    assert {r["malformed"] for r in letters if r["attempts"] == 3} == {"nonsense", ""}
    assert {r["reason"] for r in letters} == {"no object", "no envelope", "empty"} and {r["origin"].rsplit("/", 1)[1] for r in letters} == {"a.json"}


def test_heartbeats_add_up_over_batches(spark, tmp_path):
    store, reports = TaskStore(spark, f"file://{tmp_path}/store", buckets=2), f"file://{tmp_path}/reports"
    beat = lambda i, at, **m: wrapped(f"w{i}", f"beat___{i}", M.SPOT, name=M.HEARTBEAT, env="prod", metrics=m) | {"events": [wrapped(None, f"beat___{i}", M.SPOT, name=M.HEARTBEAT, env="prod", metrics=m)["events"][0] | {"time": at}]}
    put(tmp_path / "in", "a", T0, beat(0, "2024-01-01T00:05:10Z", submitAmount=4, other=9), beat(1, "2024-01-01T00:05:50Z", submitAmount=8), wrapped("t", "a___1"))
    put(tmp_path / "in", "b", T0 + 60, beat(2, "2024-01-01T00:05:00Z", submitAmount=3, maxSubmitDuration=7), beat(3, "2024-01-01T00:06:00Z"))  # late for its minute; and one without figures
    put(tmp_path / "in", "c", T0 + 120, wrapped("u", "b___1"))
    q = ingest.stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/check", files_per_batch=1, reports=reports)
    q.awaitTermination(200)
    assert q.exception() is None
    out = {(r["env"], r["period_start"].minute, r["metric"]): (r["amount"], r["avg_value"], r["max_value"]) for r in ingest.heartbeats_of(spark, reports).collect()}
    assert out == {("prod", 5, "submitAmount"): (3, 5.0, 8.0), ("prod", 5, "maxSubmitDuration"): (1, 7.0, 7.0)}
    assert sorted(r["task_id"] for r in store.tasks().collect()) == ["a___1", "b___1"]
