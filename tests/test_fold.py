"""The fold against the status machine walked in plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from taskloom import model as M
from taskloom.operators.fold import fold

T0 = dt.datetime(2024, 1, 1)


def walk(events):
    """(status, reason, name, parent, begin, end) of one task's events, as dicts in order."""
    status = reason = name = parent = begin = end = None
    for e in events:
        name = name or e["name"] or "job"
        if parent is None:
            parent = e["parent_id"]
        elif e["parent_id"] is not None and e["parent_id"] != parent:
            status, reason = M.CORRUPTED, M.DIFFERENT_PARENT
        kind = e["type"]
        if kind == M.SPOT:
            status = e["status"]
        elif kind == M.INFO:
            status = status or M.PARTIAL_INFO
        elif status == M.CORRUPTED:
            pass
        elif kind == M.START:
            if status in (M.UNTERMINATED, M.SUCCESS, M.ERROR):
                why = M.STARTED_TIME if begin is not None and begin != e["time"] else M.STARTED_NAME if name != e["name"] else M.STARTED_PARENT if parent is not None and parent != e["parent_id"] else None
                status, reason = (M.CORRUPTED, why) if why else (status, reason)
            else:
                status = {M.PARTIAL_SUCCESS: M.SUCCESS, M.PARTIAL_ERROR: M.ERROR}.get(status, M.UNTERMINATED)
        else:
            own, other = ("SUCCESS", "ERROR") if kind == M.SUCCESS_EVENT else ("ERROR", "SUCCESS")
            if status == M.UNTERMINATED:
                status = own
            elif status in (other, f"PARTIAL_{other}"):
                status, reason = M.CORRUPTED, M.CLOSED_STATUS
            elif status in (own, f"PARTIAL_{own}"):
                if end is not None and end != e["time"]:
                    status, reason = M.CORRUPTED, M.CLOSED_TIME
            else:
                status = f"PARTIAL_{own}"
        if kind in (M.START, M.SPOT):
            begin = begin or e["time"]
        if kind in (M.SUCCESS_EVENT, M.ERROR_EVENT, M.SPOT):
            end = end or e["time"]
    return status, reason, name, parent, begin or events[0]["time"], end


def event(task, seq, kind, time, name=None, parent=None, status=None, **maps):
    return {"type": kind, "task_id": task, "seq": seq, "time": T0 + dt.timedelta(seconds=time), "name": name, "parent_id": parent, "status": status, "env": "default", "primary_id": None, "parents_path": None, "orphan": None, "date_to_delete": None, "strings": maps.get("strings"), "text": None, "context": None, "metrics": maps.get("metrics")}


def test_random_sequences(spark):
    rng = random.Random(5)
    tasks, rows = {}, []
    for t in range(1500):
        task, events = f"job___{t}", []
        for i in range(rng.randrange(1, 7)):
            kind = rng.choice([M.START, M.START, M.INFO, M.SUCCESS_EVENT, M.ERROR_EVENT] + [M.SPOT] * (t % 3 == 0))
            named = kind in (M.START, M.SPOT)
            events.append(event(task, t * 10 + i, kind, rng.choice([1, 1, 2]), rng.choice(["job", "job", "job2"]) if named else None, rng.choice([None, "p", "p", "q"]) if named else None, rng.choice([M.SUCCESS, M.ERROR, M.CORRUPTED]) if kind == M.SPOT else None))
        tasks[task] = walk(events)
        rows += events
    rng.shuffle(rows)
    found = fold(spark.createDataFrame(rows, M.EVENT).repartition(5), with_maps=False).collect()
    got = {r["task_id"]: (r["status"], r["reason"], r["name"], r["parent_id"], r["task_begin"], r["task_end"]) for r in found}
    wrong = [(k, got[k], v) for k, v in tasks.items() if got[k][0] != v[0] or got[k][2:] != v[2:] or (v[0] == M.CORRUPTED and "SpotEvent" not in str([e["type"] for e in rows if e["task_id"] == k]) and got[k][1] != v[1])]
    assert not wrong, wrong[:3]


def test_maps_last_write_and_duration(spark):
    rows = [
        event("a___1", 1, M.START, 0, "a", strings={"k": "1", "x": "x"}, metrics={"m": 1.0}),
        event("a___1", 3, M.SUCCESS_EVENT, 2, strings={"k": "3"}),
        event("a___1", 2, M.INFO, 1, strings={"k": "2"}, metrics={"m": 2.0, "n": float("inf")}),
    ]
    r = fold(spark.createDataFrame(rows, M.EVENT), F.lit("2024-01-01 10:00:00").cast("timestamp"), 3, version="v7").first()
    assert (r["status"], r["duration"], r["name"]) == (M.SUCCESS, 2000, "a")
    assert r["string"] == {"k": "3", "x": "x", "clientVersion": "v7"} and r["metric"] == {"m": 2.0, "n": float("inf")}
    assert r["date_to_delete"] == dt.datetime(2024, 1, 4)


def test_reason_reaches_strings(spark):
    rows = [event("a___1", 1, M.SUCCESS_EVENT, 1), event("a___1", 2, M.ERROR_EVENT, 2)]
    r = fold(spark.createDataFrame(rows, M.EVENT)).first()
    assert r["status"] == M.CORRUPTED and r["string"] == {M.REASON: M.CLOSED_STATUS}


def test_empty(spark):
    assert fold(spark.createDataFrame([], M.EVENT)).count() == 0


def test_many_events_after_a_spot(spark):
    """Slices of a walk, put together, are the walk."""
    from taskloom.operators import fold

    rng = random.Random(5)
    rows = []
    for t in range(40):
        at = rng.randrange(3)
        rows += [event(f"t___{t}", i, M.SPOT if i == at else rng.choice([M.START, M.INFO, M.SUCCESS_EVENT, M.ERROR_EVENT]), rng.randrange(2), rng.choice(["t", None]), rng.choice(["p", "q", None, None]), status=rng.choice([M.SUCCESS, M.ERROR, "odd", None]) if i == at else None) for i in range(rng.randrange(4, 12))]
    e = fold.prepared(spark.createDataFrame(rows, M.EVENT))
    sums = fold._summed(e.withColumn("named_date", F.lit(None).cast("timestamp")))
    whole = {r["task_id"]: tuple(r) for r in fold._after_spots(e, sums).collect()}
    assert len(whole) == 40 and {r["task_id"]: tuple(r) for r in fold._after_spots(e, sums, 2).collect()} == whole


def test_sums_are_hashed_not_sorted(spark):
    """All sums have a fixed width, and what they point at is fetched in one more pass."""
    from taskloom.operators import fold

    rows = [
        event("a___1", 2, M.START, 1, "first", "p"), event("a___1", 1, M.INFO, 0), event("a___1", 3, M.START, 1, "second", "q"),
        event("c___1", 1, M.START, 1, "c", "p"), event("c___1", 2, M.START, 1, "other", "p"), event("b___1", 1, M.INFO, 0, None, None), event("b___1", 2, M.INFO, 0, "named", None),
    ]
    raw = spark.createDataFrame(rows, M.EVENT)
    e = fold.prepared(raw).withColumn("named_date", F.lit(None).cast("timestamp"))
    plan = fold._summed(e)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "HashAggregate" in plan
    details = fold._details(e, fold._summed(e))
    assert "SortAggregate" not in details._jdf.queryExecution().executedPlan().toString()
    found = {r["task_id"]: (r["name"], r["parent_id"], r["status"], r["string"].get(M.REASON)) for r in fold.fold(raw).collect()}
    # the first event of a task names it, if only by its id
    assert found["a___1"] == ("a", "p", M.CORRUPTED, M.DIFFERENT_PARENT) and found["c___1"] == ("c", "p", M.CORRUPTED, M.STARTED_NAME)
    assert found["b___1"] == ("b", None, M.PARTIAL_INFO, None)
    without_env = fold.fold(raw.withColumn("env", F.lit(None).cast("string")), with_maps=False).filter("task_id = 'a___1'").first()
    assert (without_env["name"], without_env["parent_id"], without_env["status"]) == ("a", "p", M.CORRUPTED)


def test_special_numbers_survive(spark):
    values = {"nan": float("nan"), "inf": float("inf"), "low": -float("inf"), "zero": -0.0, "tiny": 5e-324, "third": 1 / 3, "null": None}
    got = fold(spark.createDataFrame([event("a___1", 1, M.START, 0, metrics=values)], M.EVENT)).first()["metric"]
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in values.items()}
