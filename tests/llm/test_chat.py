"""Chat formatting of conversations whose turn numbers do not tell their rows apart."""

from pyspark.sql import functions as F

from taskloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def model(spark):
    return chat.train(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_a_conversation_without_turn_numbers_is_cut(spark):
    m = model(spark)
    same = F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "User: why").otherwise("Assistant: so"), "id")
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), F.when(F.col("id") < 2000, 0).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), same.alias("text"))
    lines = chat.segmented(chat.lines_of(rows), 256)
    assert lines.count() == 3000 and lines.groupBy("conv", "segment").count().agg(F.max("count")).first()[0] <= 256
    show = lambda s: sorted(map(str, chat.parse(rows, m, segment=s).collect()))
    cut = show(100)
    assert len(cut) == 3000 and cut == show(10**9)


def test_one_long_turn_is_cut(spark):
    rows = spark.createDataFrame([(1, 5, "user", "\n".join(map(str, range(2000))))], SCHEMA)
    assert chat.segmented(chat.lines_of(rows), 256).groupBy("conv", "segment").count().agg(F.max("count")).first()[0] <= 256
    assert [(r["role"], r["n_lines"]) for r in chat.parse(rows, model(spark)).collect()] == [("user", 2000)]


def test_rows_without_a_number_are_turns_of_their_own(spark):
    rows = [(1, None, "user", "yes"), (1, None, "user", "yes"), (1, None, "assistant", "go on"), (2, 0, None, "so"), (2, 0, "", "so"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    out = chat.parse(spark.createDataFrame(rows, SCHEMA), model(spark)).collect()
    assert sorted((r["conv_id"], r["n_lines"]) for r in out) == [(1, 1), (1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert sum(r["rendered"] == "<|user|>\nyes\n<|end|>\n" for r in out) == 2


def test_marker_after_a_long_indent(spark):
    rows = spark.createDataFrame([(1, 0, None, " " * 70 + "Assistant: \tyes")], SCHEMA)
    assert [(r["role"], r["rendered"]) for r in chat.parse(rows, model(spark)).collect()] == [("assistant", "<|assistant|>\nyes\n<|end|>\n")]
