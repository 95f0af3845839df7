"""The client's texts of stacks, and customers dealt out to tasks."""

import traceback

from taskloom.plans import logs, service
from taskloom.sources import client, files


def test_texts_are_those_of_traceback(monkeypatch):
    def fail(x):
        raise KeyError(x)

    def caught(x, plain=False):
        try:
            fail(x)
        except KeyError as e:
            return "".join(traceback.format_exception(e)) if plain else client.error_text(e)

    calls, formatted = [], traceback.format_tb
    monkeypatch.setattr(traceback, "format_tb", lambda *a: calls.append(1) or formatted(*a))
    assert [caught(i) for i in range(5)] == [caught(i, True) for i in range(5)]
    assert len(calls) == 1  # one place, formatted once
    both = lambda: (client.stack_text(), "".join(traceback.format_stack()))
    for _ in range(2):
        ours, plain = both()
        assert ours == plain
    try:
        try:
            fail(1)
        except KeyError as e:
            raise ValueError("outer") from e
    except ValueError as e:
        assert client.error_text(e) == "".join(traceback.format_exception(e))


def test_one_file_of_customers_is_emitted_by_many_tasks(spark, tmp_path):
    spark.range(64).selectExpr("id AS c_custkey", "'S' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = service._client_rows(spark, f"file://{tmp_path}").selectExpr("spark_partition_id() AS p", "seq_base", "value").collect()
    assert logs.table(spark, f"file://{tmp_path}", "customer").rdd.getNumPartitions() == 1 and len({r["p"] for r in rows}) > 1
    assert len({r["seq_base"] for r in rows}) == len(rows) and {r["seq_base"] // 100 for r in rows} == set(range(64))


def test_a_line_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([('{"id":"w","events":[{"@type":"InfoEvent","taskId":"a___1"}]}', 1), ("nonsense", 2)], "value string, seq_base long").write.parquet(f"{tmp_path}/lines")
    events = files.events_of(files.envelopes_from_text(spark.read.parquet(f"{tmp_path}/lines")))
    assert events._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r["task_id"] for r in events.collect()] == ["a___1"]
