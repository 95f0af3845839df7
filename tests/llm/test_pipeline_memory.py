"""What the pipeline holds in Python at a time is bounded in bytes, in every stage that stores something, and its rows stay the same."""

from collections import Counter

import pytest
from test_operators import odd_rows, small

import corpus_pipeline
from taskloom.llm import _blocks, exact_dedup, jaccard_join

ROWS = [(i, f"text {i} " + "".join(chr(97 + (i * k) % 26) for k in range(1500)), "en", "web") for i in range(3000)]


def test_copies_come_to_python_a_little_at_a_time(spark, monkeypatch):
    docs, name = small(spark, ROWS, 1), "spark.sql.execution.arrow.maxBytesPerBatch"
    before, real, seen = spark.conf.get(name), exact_dedup.stored, []

    def noted(df, tag, batch="8m", **options):
        seen.append((tag, batch))
        return real(df, tag, batch, **options)

    monkeypatch.setattr(exact_dedup, "stored", noted)
    out = corpus_pipeline.exact_dedup(spark, docs, "")
    assert seen == [("exact-owners", "2m")] and spark.conf.get(name) == before
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [r[0] for r in ROWS]


def test_near_copies_are_sought_in_small_blocks(spark, monkeypatch):
    made, real = [], jaccard_join.block_table

    def noted(*args):
        made.append(real(*args).select("n_bytes").collect())
        return real(*args)

    monkeypatch.setattr(jaccard_join, "block_table", noted)
    corpus_pipeline.jaccard_dedup(spark, small(spark, ROWS, 1), "").count()
    assert len(made[0]) >= 4 and max(r["n_bytes"] for r in made[0]) <= 1 << 20 < _blocks.BLOCK_BYTES


@pytest.mark.parametrize("seed", [1, 2])
def test_block_size_leaves_rows_alone(spark, seed):
    docs = small(spark, odd_rows(seed))
    want = Counter(tuple(r) for r in jaccard_join.drop_near_copies(docs).collect())
    assert Counter(tuple(r) for r in jaccard_join.drop_near_copies(docs, block_bytes=200, resting=False).collect()) == want
