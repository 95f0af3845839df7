"""Texts come to the pipeline's encoders a little at a time, whatever the session's own setting."""

from test_operators import small

import corpus_pipeline
from taskloom.llm import _common


def test_tokens_in_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, small_batches = spark.conf.get(name), _common.small_batches

    def noted(*args):
        seen.append(args[1:])
        return small_batches(*args)

    monkeypatch.setattr(_common, "small_batches", noted)
    out = corpus_pipeline.tokens(spark, small(spark, [(1, "some words", None, None), (2, None, None, None)]), "")
    assert seen == [("2m",)] and spark.conf.get(name) == before
    assert sorted((r["doc_id"], r["n_tokens"] > 0) for r in out.collect()) == [(1, True), (2, False)]
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_workers_at_rest_hold_no_tables(spark):
    from taskloom.llm.bpe import public_ranks, tokenize

    def held(batches):
        import time

        import pyarrow as pa

        time.sleep(0.5)
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(_common.WORKER_TABLES.get("bpe", {}))])], ["n"])

    docs = small(spark, [(i, f"word {i}", None, None) for i in range(40)]).repartition(4)
    tables = lambda: sum(r["n"] for r in spark.range(0, 8, 1, 4).mapInArrow(held, "n long").collect())
    tokenize(docs, *public_ranks()).collect()
    assert tables() > 0
    corpus_pipeline.tokens(spark, docs, "").collect()
    tokenize(docs, *public_ranks(), resting=False).collect()
    assert tables() == 0
