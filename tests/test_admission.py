"""Admission where an id comes more than twice."""

import random

import pytest
from pyspark.sql import functions as F

from taskloom.operators import admission


def test_a_window_opens_with_the_last_one_let_in(spark):
    rows = [("a", 0, 0), ("a", 19, 1), ("a", 21, 2), ("a", 29, 3), ("b", 0, 4), ("b", 0, 5), ("b", 9, 6), ("b", 10, 7), (None, 0, 8), (None, 0, 9)]
    e = spark.createDataFrame(rows, "id string, s long, n long").selectExpr("id", "timestamp_seconds(s) AS received", "n")
    assert sorted(r["n"] for r in admission.once_per_window(e, order="n").collect()) == [0, 1, 3, 4, 7, 8, 9]


def test_batches_by_size_need_a_queue(spark):
    with pytest.raises(TypeError):
        admission.by_size(spark.range(1), 10, F.lit(1))


def test_batches_start_empty_and_end_with_the_event_that_exceeds(spark):
    rows = [("a", i, s, t) for i, (s, t) in enumerate([(4, 0), (4, 0), (4, 0), (9, 0), (1, 0), (1, 90), (1, 95), (20, 96), (20, 97)])] + [("b", 0, 1, 0), ("b", 1, 99, 500), (None, 0, 1, 0)]
    e = spark.createDataFrame(rows, "client string, seq long, size long, s long").selectExpr("*", "timestamp_seconds(s) AS time")
    out = {(r["client"], r["seq"]): r["batch"] for r in admission.by_size(e, 10, F.col("size"), "client", 60).collect()}
    assert [out["a", i] for i in range(9)] == [0, 0, 0, 1, 1, 2, 2, 2, 3]
    assert (out["b", 0], out["b", 1], out[None, 0]) == (0, 1, 0)


def _walked(rows, most, seconds):
    """Batches by walking each queue in order."""
    out, state = {}, {}
    for client, seq, size, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        at, n = s or 0, max(size or 0, 0)
        if client not in state:
            state[client] = [0, 0, at]
        elif state[client][1] > most or (seconds is not None and at - state[client][2] > seconds):
            state[client] = [state[client][0] + 1, 0, at]
        state[client][1] += n
        out[client, seq] = state[client][0]
    return out


@pytest.mark.parametrize("most, seconds, slice_rows", [(30, 60, 7), (30, None, 1), (300, 400, 5), (10**9, None, 4), (0, 20, 16), (-1, None, 3)])
def test_a_queue_is_cut_in_many_slices_at_once(spark, most, seconds, slice_rows):
    rng = random.Random(most + slice_rows)
    rows = [(q, i, rng.choice([None, 0, 0, 1, 5, 12, 90]), rng.choice([None, i * 7 + rng.randint(-40, 40)]) if rng.random() < 0.1 else i * 7 + rng.randint(-40, 40)) for q, n in (("hot", 700), ("b", 90), ("c", 1), (None, 40)) for i in range(n)]
    e = spark.createDataFrame(rows, "client string, seq long, size long, s long").selectExpr("*", "timestamp_seconds(s) AS time")
    out = [(r["client"], r["seq"], r["batch"]) for r in admission.by_size(e, most, F.col("size"), "client", seconds, slice_rows=slice_rows).collect()]
    assert len(out) == len(rows)
    assert {(c, s): b for c, s, b in out} == _walked(rows, most, seconds)


def test_no_events_make_no_batches(spark):
    e = spark.createDataFrame([], "client string, seq long, size long, time timestamp")
    assert admission.by_size(e, 10, F.col("size"), "client", 60).count() == 0
