"""The pipeline's last two stages, row by row, against plain versions (the first three are in ``test_operators``)."""

import collections
import hashlib
import math

import brute
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _copies(rows) -> collections.Counter:
    """How often each document comes out of mixing by the roots of its source's number of rows."""
    size = collections.Counter(r["source"] for r in rows)
    roots = sum(math.sqrt(n) for n in size.values())
    seen, out = collections.Counter(), collections.Counter()
    for r in rows:
        rate = math.sqrt(size[r["source"]]) / roots * len(rows) / size[r["source"]]
        md5 = hashlib.md5((r["text"] or "").encode()).hexdigest()
        seen[r["doc_id"], md5] += 1
        out[r["doc_id"]] += brute.poisson_copies(f"{'-' if r['doc_id'] is None else r['doc_id']}:{md5}:{seen[r['doc_id'], md5]}", rate, 11)
    return +out


def test_mixing_and_tokens(spark):
    import corpus_pipeline
    import tiktoken

    from taskloom.llm import bpe

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast(docs.schema["doc_id"].dataType), "source": F.lit(None).cast("string")})
    docs = docs.unionByName(odd.withColumn("text", F.lit(None).cast("string")).limit(1))
    rows = docs.collect()
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert copies == _copies(rows)

    ranks, pattern = bpe.public_ranks()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    texts, want = {r["doc_id"]: r["text"] or "" for r in rows}, collections.Counter()
    for i, n in copies.items():
        ids = own.encode_ordinary(texts[i])
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()] += n
    got = stages["byte_bpe"](spark, mixed, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
