"""Clashing names, hot keys, missing and repeated ids, and plain versions of what has no SQL."""

import collections
import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import odd_rows, small, some, sorted_rows


def with_names(df, *names):
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


# what the operators share


def test_join_owners_deals_hot_keys_out(spark):
    from taskloom.llm import _common

    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id").repartition(4)
    owners = rows.groupBy("k").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n"))
    got = _common.join_owners(rows, owners, ["k"], "n")
    want = rows.join(owners.drop("n"), "k")
    assert sorted_rows(got.select("id", "k", "owner")) == sorted_rows(want.select("id", "k", "owner"))
    dealt = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "__slice" in x]
    assert dealt
    few = _common.join_owners(rows, owners.filter("k = 'hot'"), ["k"], "n", "left", most=6000)
    assert few.count() == 6000 and few.filter("owner IS NULL").count() == 4000


def test_tables_are_forgotten_and_settings_stay(spark):
    from taskloom.llm import _common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    t = _common.stored(spark.range(5), "t")
    assert spark.conf.get(name) == before and t.count() == 5
    _common.forget(t)
    assert spark.read.parquet(t.stored_at).count() == 0


def test_workers_collect_garbage_after_tokens(spark):
    import gc

    import pyarrow as pa

    from taskloom.llm import bpe

    ranks, pattern = bpe.public_ranks()
    bpe.tokenize(small(spark, [(i, "some words here", None, None) for i in range(20)]), ranks, pattern).count()

    def asks(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"on": [gc.isenabled()]})

    assert {r["on"] for r in spark.range(8, numPartitions=4).mapInArrow(asks, "on boolean").collect()} == {True}


@pytest.mark.parametrize("per_slice", [1, 1000])
def test_shared_keys_by_slices(spark, per_slice):
    from taskloom.llm import _blocks

    texts = [f"{i % 7} {i % 3} {i}" for i in range(60)]
    blocks = _blocks.block_table(small(spark, [(i, t, None, None) for i, t in enumerate(texts)], 5), "doc_id", "text", "t", block_bytes=40)

    def keys(b):
        return np.concatenate([np.unique(np.array([int(w) * 0x9E3779B97F4A7C15 % (1 << 64) for w in t.decode().split()], np.uint64)) for t in b.texts()])

    found = collections.Counter()
    for r in _blocks.shared_keys(blocks, keys, 3, per_slice).collect():
        for low, n in zip(np.frombuffer(r["keys"], np.uint32).tolist(), np.frombuffer(r["counts"], np.uint32).tolist()):
            found[low] = max(found[low], n)
    want = collections.Counter(int(w) * 0x9E3779B97F4A7C15 % (1 << 64) for t in texts for w in set(t.split()))
    assert found == {k & 0xFFFFFFFF: n for k, n in want.items() if n > 1}


# 1


def test_mixing_draws_for_every_row(spark):
    from taskloom.llm.mixing import mix

    names = ["__source", "__rate", "__copies", "__copy", "__order", "row", "tie", "position"]
    docs = with_names(small(spark, [(None, "t", None, "a")] * 1000 + [(7, f"t{i % 10}", None, "a") for i in range(500)]), *names)
    out = mix(docs, {"a": 1.0}, total=3.0)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[len(docs.columns) :] == ["___copy", "___copies", "___rate", "___order"]
    null = out.filter("doc_id IS NULL")
    assert abs(null.count() - 3000) < 300 and null.select("___order").distinct().count() == null.count()
    md5 = hashlib.md5(b"t").hexdigest()
    want = collections.Counter(brute.poisson_copies(f"-:{md5}:{p}", 3.0, 11) for p in range(1, 1001))
    got = collections.Counter(r["n"] for r in null.filter("___copy = 1").groupBy("___copies").agg(F.count("*").alias("k")).selectExpr("___copies AS n", "k").collect() for _ in range(r["k"]))
    assert got == {k: n for k, n in want.items() if k}
    seven = mix(docs.filter("doc_id = 7"), {"a": 1.0}, total=3.0)
    assert sorted_rows(mix(docs.filter("doc_id = 7").repartition(5), {"a": 1.0}, total=3.0).drop("tie")) == sorted_rows(seven.drop("tie"))


def test_weights_of_missing_and_empty_sources(spark):
    from taskloom.llm.mixing import mix, repetition_rates

    docs = small(spark, [(1, "a", None, None), (2, "b", None, ""), (3, None, None, "x")])
    assert {r["source"]: r["rate"] for r in repetition_rates(docs, {"": 1.0}).collect()} == {None: 0.0, "": 3.0, "x": 0.0}
    assert {r["source"]: r["rate"] for r in repetition_rates(docs, {None: 1.0}).collect()} == {None: 3.0, "": 0.0, "x": 0.0}
    assert mix(docs, {None: 1.0}, total=5.0).select("doc_id").distinct().collect() == [(1,)]
    long = small(spark, [(1, "x" * 300000, None, "s")])
    assert mix(long, {"s": 1.0}, total=4.0).select(F.length("text")).distinct().collect() == [(300000,)]


# 2


def test_sharding_numbers_and_back(spark):
    from taskloom.llm.sharding import row_number_at, shard

    rows = [(i, t, None, None) for i, t in [(None, None), (None, ""), (3, "a" * 100000), (3, "b"), (9, None)] + [(100 + i, f"t{i}") for i in range(300)]]
    docs = with_names(small(spark, rows), "__h", "__bucket", "__i", "size", "shard")
    out = shard(docs).collect()
    got = collections.defaultdict(list)
    for r in out:
        got[r["doc_id"], r["text_crc32"]].append(r["row_number"])
    import zlib

    want = collections.defaultdict(list)
    for (i, t, *_), n in zip(rows, brute.row_numbers([r[:2] for r in rows])):
        want[i, zlib.crc32((t or "").encode())].append(n)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    places = spark.createDataFrame([(r["shard"], r["slot"], r["row_number"]) for r in out], "shard int, slot long, n long")
    assert places.filter(row_number_at(F.col("shard"), F.col("slot"), F.lit(len(rows)).cast("long")) != F.col("n")).count() == 0


# 3


def test_jaccard_with_the_largest_id_and_long_texts(spark):
    from taskloom.llm.jaccard_join import jaccard_components

    big = (1 << 63) - 1
    text = " ".join(f"w{i}" for i in range(30000))
    rows = [(big, "only this one here now", None, None), (None, "another one that stands alone", None, None), (5, text, None, None), (big - 1, text + " end", None, None), (None, text, None, None), (None, None, None, None)]
    out = sorted_rows(jaccard_components(with_names(small(spark, rows), "rows", "top", "least", "root", "__slice")))
    assert out == sorted([(big, 1, big), (None, 1, None), (5, 29996, 5), (big - 1, 29997, 5), (None, 29996, 5), (None, 0, None)], key=str)


# 4


def test_mixture_against_plain_version(spark):
    from taskloom.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, logs = langid.fit_languages(langid.training_rows(docs))
    texts = [r["text"] for r in docs.filter("text IS NOT NULL AND length(text) BETWEEN 40 AND 400").orderBy("doc_id").limit(30).collect()]
    texts += [texts[0] + " " + texts[7], texts[3] + " " + texts[11] + " " + texts[20], "ü"]
    plain = logs.astype(float).tolist()
    for t in texts:
        counts = langid.trigram_counts(t.encode())
        want = brute.mixture({int(g): int(counts[g]) for g in np.flatnonzero(counts)}, plain, langid.STEPS, langid.OVERLAP)
        assert np.allclose(langid.infer(counts, logs), want, atol=1e-6)
    assert langid.identify(small(spark, []), languages, logs).count() == 0
    clash = with_names(small(spark, [(1, texts[0], None, None)]), "__id", "__text", "__k0", "score", "mixture")
    kept = langid.keep_identified(clash.unionByName(with_names(docs, "__id", "__text", "__k0", "score", "mixture")))
    assert kept.columns == clash.columns and {r["score"] for r in kept.select("score").distinct().collect()} == {3}


# 5


def test_roles_against_plain_viterbi(spark):
    from taskloom.llm import chat

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.train(turns)
    exact = chat.Model(*[np.round(x * (1 << 20)) / (1 << 20) for x in (model.first, model.move, model.mark, model.size, model.asks)])
    hidden = turns.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) > 0, F.col("role")))
    lines = collections.defaultdict(list)
    for r in chat.lines_of(hidden).collect():
        lines[r["conv"]].append((r["turn"], r["copy"], r["rep"], r["line"], r["new"], r["marker"], r["size"], r["asks"]))
    want = collections.Counter()
    for conv, rows in lines.items():
        rows = sorted(set(rows))
        for r, role in zip(rows, brute.viterbi(exact, *map(list, zip(*[r[4:] for r in rows])))):
            want[conv, r[0], chat.ROLES[role]] += 1
    for segment, span in ((5, 2), (256, 256)):
        before, chat.SPAN = chat.SPAN, span
        got = collections.Counter()
        for r in chat.parse(hidden, model, segment=segment).collect():
            got[r["conv_id"], r["turn"], r["role"]] += r["n_lines"]
        chat.SPAN = before
        assert got == want


def test_markers_wherever_they_stand(spark):
    from taskloom.llm.chat import lines_of

    blanks = " " * 500
    rows = [(1, 0, None, blanks + "Assistant: hi"), (1, 1, None, "###" + blanks + "User:" + blanks + "yes"), (1, 2, None, "x" * 70 + "\nuSeR: no"), (1, 3, None, "word user: no")]
    out = {(r["turn"], r["line"]): (r["marker"], r["body"]) for r in lines_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {(0, 0): (3, "hi"), (1, 0): (2, "yes"), (2, 0): (0, "x" * 70), (2, 1): (2, "no"), (3, 0): (0, "word user: no")}


# 7


def test_drop_copies_keeps_columns_of_any_name(spark):
    from taskloom.llm.exact_dedup import drop_copies

    names = ["__id", "__n", "__h", "__sha", "__rows", "row", "n", "sha", "owner", "rows", "tie"]
    docs = with_names(small(spark, odd_rows(9, 150) + [(5, "same", "en", "a"), (5, "same", "de", "a"), (None, "SAME", "en", None)]), *names)
    kept = drop_copies(docs)
    assert [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in docs.schema]
    assert {tuple(r) for r in kept.select(*names).distinct().collect()} == {tuple(range(len(names)))}
    plain = drop_copies(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert sorted_rows(plain.select("doc_id", F.lower("text"))) == sorted_rows(kept.select("doc_id", F.lower("text")))
    again = [sorted_rows(drop_copies(docs.repartition(k)).filter("doc_id = 5 AND lower(text) = 'same'")) for k in (1, 6)]
    assert len(again[0]) == 1 and again[0] == again[1]


# 8


def test_repeats_in_hot_and_periodic_texts(spark):
    from taskloom.llm.repeats import remove_repeats

    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, page = letters(300), letters(1500)
    rows = [(i, letters(rng.randrange(40)) + hot + letters(rng.randrange(40)), None, None) for i in range(60)]
    for i in range(60, 90):  # near copies: a few letters put in, taken out or changed
        t = list(page)
        for _ in range(3):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(3)] = letters(rng.randrange(3))
        rows.append((i, "".join(t), None, None))
    rows += [(100 + i, x, None, None) for i, x in enumerate(["a" * 5000, "a" * 700, "ab" * 300, "ba" * 400, "abc" * 90, "x" + "abc" * 90, hot * 9, "the same line of text, over and over\n" * 50, "the same line of text, over and over\n" * 3])]
    rows += [((1 << 63) - 2, hot, None, None), (None, hot + "!", None, None), (None, hot + "!", None, None)]
    want = sorted(brute.remove_repeats([r[:2] for r in rows]), key=str)
    docs = some(small(spark, rows))
    for heavy in (3, 256):
        assert sorted_rows(remove_repeats(docs, heavy=heavy).drop("kept")) == want
    assert remove_repeats(small(spark, [((1 << 63) - 1, "x", None, None), (None, "y", None, None)])).filter("doc_id IS NULL").count() == 1


# 9


def test_quality_of_nothing_and_of_long_texts(spark):
    from taskloom.llm.quality import score_quality

    assert score_quality(small(spark, [])).count() == 0
    docs = with_names(small(spark, [(1, "palabra uno dos tres cuatro cinco seis " * 20000, None, None), (2, "ord " * 9, None, None)]), "__id", "n_words", "kept", "failed_rules")
    out = {r["doc_id"]: r for r in score_quality(docs).collect()}
    assert out[1]["n_words"] == 140000 and out[1]["n_repeat_words"] == 140000 and out[1]["base_failed"] and out[2]["base_failed"]
    other = " ".join(f"ord{i}" for i in range(60))
    mine = score_quality(small(spark, [(1, other, None, None), (2, other + " og og og", None, None)]), stop_words=("og",)).collect()
    assert {r["doc_id"]: r["kept"] for r in mine} == {1: False, 2: True}
