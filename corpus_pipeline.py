"""A corpus pipeline: language, exact copies, near copies, mixing of sources, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
``documents``; the last one returns the tokens' digests. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again, so a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskloom.llm._common import stored, table
from taskloom.llm.bpe import KEPT, public_ranks, tokenize
from taskloom.llm.exact_dedup import drop_copies
from taskloom.llm.jaccard_join import drop_near_copies
from taskloom.llm.langid import keep_identified
from taskloom.llm.mixing import mix

#: Texts come to Python so many bytes at a time, and near copies are sought in blocks of so many bytes of text: one session runs all stages, and executors
#: keep the heap that they once took, so what stands beside it has to be small.
BATCH, BLOCK_BYTES = "2m", 1 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, which replaces their label; those without text or letters go.

    Null ids and repeated rows pass through, each judged by its own text; where no document has a label, labels stay;
    no documents give none; columns of any name pass through."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the document with the largest doc_id.

    Rows that repeat its id, too, are one document; without any id in a group all its rows stay; columns of any name pass through."""
    return drop_copies(docs, batch=BATCH)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5 words, similarity 0.75 or more) the document with the least doc_id.

    Documents without an id or without words all stay, as do rows that repeat the id that stays; columns of any name pass through."""
    return drop_near_copies(docs, block_bytes=BLOCK_BYTES, resting=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts to their sources' target shares, in a global random order.

    A missing source is a source; rows without an id, or that repeat one, have draws of their own; columns of any name pass through."""
    return mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every copy; a null text is empty, and a null id stays null.

    Executors are full of what the stages before it left in their heaps, and encoders keep tables, so texts come to them a little at a time,
    and a worker that rests has none."""
    ranks, pattern = public_ranks()
    return stored(tokenize(docs, ranks, pattern, with_ids=False, kept=KEPT // 2, resting=False).drop("ids"), "pipeline-byte_bpe", batch=BATCH)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("jaccard_dedup", jaccard_dedup), ("mixing", mixing), ("byte_bpe", tokens)]

#: Neither language identification nor BPE can be said in SQL; the tests run the stages' plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
