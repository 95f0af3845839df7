"""The operators against plain versions, on small tables with nulls, blanks, ties, repeats and long texts."""

import base64
import collections
import hashlib
import math
import random
import zlib

import brute
import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small(spark, rows, parts=3):
    rows = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def odd_rows(seed=1, n=120):
    """Texts with shared passages, copies, repeats, nulls and blanks; ids repeat or are null now and then."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abc é") for _ in range(rng.choice([49, 50, 51, 60, 130]))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyz \n") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(5))]
        rows.append((rng.choice([i, i, i, i, 7, None]), "".join(parts) or rng.choice([None, "", " \n"]), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None])))
    return rows


def some(df):
    """With extra columns whose names are used inside."""
    return df.withColumns({"id": F.lit("x"), "h": F.lit(1), "block": F.lit(2), "key": F.lit(3), "node": F.lit(4)})


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1


def test_poisson_counts(spark):
    from taskloom.llm.mixing import poisson, uniform

    for mean in (0.3, 2.5, 100.0):
        got = spark.range(4000).select(poisson(F.lit(mean), 3, F.col("id")).alias("k"), uniform(3, F.col("id"), F.lit(1)).alias("u")).collect()
        if mean <= 32:
            for r in got[:300]:
                k, p = 0, math.exp(-mean)
                cdf = p
                while r["u"] >= cdf:
                    k += 1
                    p *= mean / k
                    cdf += p
                assert r["k"] == k
        average = sum(r["k"] for r in got) / len(got)
        assert abs(average - mean) < 5 * math.sqrt(mean / len(got))


def test_mixing(spark):
    from taskloom.llm.mixing import mix, repetition_rates

    docs = some(small(spark, [(i, "t", None, "a" if i % 3 else "b") for i in range(3000)] + [(None, None, None, None)]))
    rates = {r["source"]: r["rate"] for r in repetition_rates(docs, {"a": 1.0, "b": 3.0}, total=2.0).collect()}
    assert rates["a"] == pytest.approx(6002 / 4 / 2000) and rates["b"] == pytest.approx(6002 * 3 / 4 / 1000) and rates[None] == 0
    out = mix(docs, {"a": 1.0, "b": 3.0}, total=2.0)
    assert out.drop("__rate", "__copies", "__copy", "__order").schema == docs.schema
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 1500) < 200 and abs(n["b"] - 4500) < 350 and None not in n
    assert mix(docs.filter("false")).count() == 0 and mix(docs, {}).count() == 0
    again = mix(docs.repartition(7), {"a": 1.0, "b": 3.0}, total=2.0)
    assert sorted_rows(again.select("doc_id", "__copy")) == sorted_rows(out.select("doc_id", "__copy"))


# 2


def plain_feistel(x, n, seed):
    from taskloom.llm.sharding import PRIME, round_keys

    bits = 0 if n <= 1 else (n - 1).bit_length()
    low = -(-bits // 2)
    mixed = lambda v, a, c: (lambda w: w * ((w >> 3) + c) % PRIME)((v * a + c) % PRIME)
    while True:
        left, high = x % (1 << low), x >> low
        for i, (a, c) in enumerate(round_keys(seed)):
            if i % 2 == 0:
                high ^= mixed(left, a, c) & ((1 << (bits - low)) - 1)
            else:
                left ^= mixed(high, a, c) & ((1 << low) - 1)
        x = (high << low) + left
        if x < n:
            return x


def test_feistel_is_a_permutation(spark):
    from taskloom.llm.sharding import feistel

    for n in (1, 2, 5, 1000, 1025):
        got = [r[0] for r in spark.range(n).select(feistel(F.col("id"), F.lit(n).cast("long"), 9)).collect()]
        assert sorted(got) == list(range(n)) and got == [plain_feistel(i, n, 9) for i in range(n)]


def spark_hash(*values):
    """xxhash64 of longs, as Spark chains it."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_sharding(spark):
    from taskloom.llm.sharding import shard

    rows = odd_rows(2, 500)
    out = shard(some(small(spark, rows)), 16).collect()
    assert len(out) == 500
    sizes = collections.Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert sorted(r["row_number"] for r in out) == list(range(500))
    for r in out:
        p = plain_feistel(r["row_number"], 500, 7)
        assert (r["shard"], r["slot"]) == (p % 16, p // 16)
    by_text = collections.Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in out) == by_text
    assert shard(small(spark, []), 16).count() == 0


# 3


@pytest.mark.parametrize("rounds", [1, 8])
def test_jaccard_components(spark, rounds):
    from taskloom.llm.jaccard_join import jaccard_components

    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (3, 6, 9, 20, 40, 80)]
    rows = []
    for i in range(220):
        d = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            k = rng.randrange(len(d) + 1)
            d[k : k + rng.randrange(2)] = [rng.choice(words)]
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([" ", "  ", "\n"]).join(d).title() if rng.random() > 0.05 else rng.choice([None, "", " \n"]), None, None))
    got = sorted_rows(jaccard_components(some(small(spark, rows)), rounds=rounds))
    assert got == sorted(brute.jaccard_components([r[:2] for r in rows]), key=str)


def test_jaccard_empty_and_drop(spark):
    from taskloom.llm.jaccard_join import drop_near_copies, jaccard_components

    assert jaccard_components(small(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = small(spark, [(5, text, "en", "a"), (3, text + " end", "en", "b"), (9, "other", None, None), (None, text, None, None), (11, None, None, None)])
    assert sorted((r[0] for r in drop_near_copies(docs).collect()), key=str) == [11, 3, 9, None]


# 4


def test_language_id(spark):
    from taskloom.llm.langid import fit_languages, held_out, identify, keep_identified, training_rows

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, logs = fit_languages(training_rows(docs))
    out = identify(docs, languages, logs).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id")))
    n, right = out.count(), out.filter("lang = lang_pred").count()
    assert right / n > 0.97
    odd = small(spark, [(1, None, None, None), (2, "", None, None), (3, "123 !?", None, None), (4, "x" * 300000, None, None), (None, "the and of that with", "zz", None)])
    got = {r["doc_id"]: r for r in identify(some(odd), languages, logs).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in languages and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert identify(odd, *fit_languages(training_rows(small(spark, [])))).filter("lang_pred != 'und'").count() == 0
    kept = keep_identified(odd.unionByName(docs))
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 2, 3) and source is null").count() == 0


def test_mixture_shares():
    import numpy as np

    from taskloom.llm.langid import infer

    logs = np.log(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7], [0.1, 0.7, 0.1, 0.1]]))
    shares = infer(np.array([500, 100, 100, 300 + 100]), logs)
    assert shares.argmax() == 0 and shares[1] > 0.2 and shares[2] == 0
    assert infer(np.array([700, 100, 100, 100]), logs).tolist() == [1, 0, 0]


# 5


def test_chat(spark):
    from taskloom.llm.chat import parse, train

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = train(turns)
    hidden = turns.withColumn("given", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) > 0, F.col("role")))
    views = [parse(hidden, model, role_col="given", segment=s) for s in (3, 1000)]
    assert sorted_rows(views[0]) == sorted_rows(views[1])
    joined = views[0].withColumnRenamed("role", "found").join(hidden, ["conv_id", "turn"]).filter("given IS NULL")
    assert joined.filter("found = role").count() / joined.count() > 0.9
    odd = spark.createDataFrame([(1, 0, None, "User: hi\nthere\n### Assistant: yes\nok"), (1, 1, "nobody", None), (None, None, "user", ""), (2, 0, "human", "<|user|> x"), (2, 0, "human", "<|user|> x")], "conv_id long, turn long, role string, text string").withColumn("line", F.lit(1))
    out = [tuple(r) for r in parse(odd, model).collect()]
    assert (1, 0, 0, "user", 2, "<|user|>\nhi\nthere\n<|end|>\n") in out and (1, 0, 1, "assistant", 2, "<|assistant|>\nyes\nok\n<|end|>\n") in out
    assert len([r for r in out if r[0] == 2]) == 1 and len([r for r in out if r[0] is None]) == 1
    assert parse(odd.filter("false"), model).count() == 0


# 6


def test_bpe(spark):
    import tiktoken

    from taskloom.llm import bpe

    ranks, pattern = bpe.public_ranks()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "don't", "a" * 3000, " " * 700 + "x", "<|endoftext|>", "日本語😀\x00‍", "the " * 5000] + ["".join(rng.choice("abcdeéß  \n\t.,'0日😀") for _ in range(rng.randrange(120))) for _ in range(200)]
    docs = some(small(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    for r in bpe.tokenize(docs, ranks, pattern).collect():
        text = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.tokenize(small(spark, []), ranks, pattern).count() == 0


def test_bpe_neighbours_and_decoder():
    from taskloom.llm import bpe

    ranks = bpe.read_ranks(bpe.public_ranks()[0])
    t, rng, tokens = bpe.Transducer(ranks, states=50), random.Random(1), list(ranks)
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert t.fits(a, b) == (t.merged(a + b) == [a, b])
    for _ in range(300):
        data = bytes(rng.choice(b"abcdehinort") for _ in range(rng.randrange(40)))
        assert t.encode(data) == [ranks[x] for x in t.merged(data)]
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0x80, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0xED, 0xA0]) for _ in range(12))
        d, cut = bpe.StreamDecoder(), rng.randrange(12)
        assert d.feed(data[:cut]) + d.feed(data[cut:]) + d.close() == data.decode("utf-8", "replace")


# 7


@pytest.mark.parametrize("budget", [1, 500, 1 << 20])
def test_exact_dedup(spark, budget, monkeypatch):
    from taskloom.llm import exact_dedup as E

    rows = odd_rows(5, 200) + [(900 + i, t, None, None) for i, t in enumerate(["aB", "Ab", "AB", "É", "é", "a" * 100000, "A" * 100000])]
    classes = collections.defaultdict(list)
    low = str.maketrans(E.UPPER, E.LOWER)
    for i, t, *_ in rows:
        classes[(t or "").translate(low)].append(i)
    owner = {t: max((i for i in ids if i is not None), default=None) for t, ids in classes.items()}
    want = [(i, owner[k], len(classes[k]), i == owner[k], hashlib.sha256(k.encode()).hexdigest()) for i, k in ((i, (t or "").translate(low)) for i, t, *_ in rows)]
    docs = some(small(spark, rows))
    monkeypatch.setattr(E.text_classes, "__defaults__", (*E.text_classes.__defaults__[:-1], budget))
    assert sorted_rows(E.exact_dedup(docs)) == sorted(want, key=str)
    kept = E.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "").translate(low)) for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({(o, t) for t, o in owner.items() if o is not None})
    assert E.exact_dedup(small(spark, [])).count() == 0


# 8


def test_suffix_array():
    from taskloom.llm.suffixes import suffix_array

    rng = random.Random(2)
    for _ in range(2000):
        s = bytes(rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(30)))
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("heavy", [2, 256])
def test_remove_repeats(spark, heavy):
    from taskloom.llm.repeats import remove_repeats

    rows = odd_rows(6, 150) + [(2000, "a" * 200, None, None), (2001, "a" * 49, None, None), (2002, "a" * 50, None, None)]
    out = remove_repeats(some(small(spark, rows)), heavy=heavy)
    assert sorted_rows(out.drop("kept")) == sorted(brute.remove_repeats([r[:2] for r in rows]), key=str)
    assert remove_repeats(small(spark, [])).count() == 0


def test_repeats_over_chunks_and_blocks(spark, monkeypatch):
    from taskloom.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK", 100)
    block = type("B", (), {"data": b"".join(bytes([97 + (i * i) % 7]) for i in range(1000)), "lens": __import__("numpy").array([400, 600])})()
    cut = [x.tolist() for x in repeats.anchors(block)]
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    assert cut == [x.tolist() for x in repeats.anchors(block)]


# 9


def test_quality_measures(spark):
    import re

    from taskloom.llm.quality import score_quality

    rng = random.Random(8)
    texts = [None, "", "\n \n", "#", "word"] + [rng.choice([" ", "\n"]).join(rng.choice(["a", "the", "bb#", "é", "x|y"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    got = {r["doc_id"]: r for r in score_quality(some(small(spark, [(i, t, None, None) for i, t in enumerate(texts)]))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


# 10


def test_warc(spark):
    from taskloom.llm import warc
    from taskloom.llm._common import work_dir

    rows = [(1, "u\r\n%", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "w", "é" * 70000), (None, "n", "x"), (6, "a", "y"), (6, "a", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    folder = work_dir(spark, "warc")
    index = warc.write_warc(warc.mark_revisits(pages), folder, file_bytes=300)
    records = [r.asDict() for r in warc.read_warc(index, folder, read_bytes=500).collect()]
    by_id = {r["page_id"]: r for r in records}
    assert len(records) == 8 and by_id[1]["record_type"] == "revisit" and by_id[1]["refers_to"] == 2 and by_id[1]["url"] == "u\r\n%"
    assert by_id[3]["refers_to"] == 4 and by_id[4]["payload_bytes"] == 0 and by_id[None]["refers_to"] == 2 and by_id[5]["payload_bytes"] == 140000
    assert by_id[2]["payload"] == b"x" and by_id[2]["payload_digest"] == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    one = warc.read_warc(index.filter("page_id = 5"), folder).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == "é" * 70000
    assert {r["record_type"] for r in warc.archive_round_trip(pages, work_dir(spark, "warc"), min_revisit_bytes=5).collect()} == {"response"}
    assert warc.archive_round_trip(pages.filter("false"), work_dir(spark, "warc")).count() == 0


def test_same_as_sql(spark):
    from helpers import compare_with_duckdb

    from taskloom.llm import queries

    for name, sql in queries.oracle_sql().items():
        compare_with_duckdb(spark, queries.queries()[name], sql, SF)


def test_pipeline(spark):
    """Every stage of the pipeline on the small tables, against plain versions of what it decides."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SF)
    assert first.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(kept) == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    second = stages["exact_dedup"](spark, first, SF)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    owner: dict = {}
    for i, t in kept.items():
        owner[low(t)] = max(owner.get(low(t), i), i)
    kept = {i: kept[i] for i in owner.values()}
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(kept)
    third = stages["jaccard_dedup"](spark, second, SF)
    stay = {c for _, _, c in brute.jaccard_components(sorted(kept.items()))}
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(stay)
    assert third.columns == docs.columns
    fourth = stages["mixing"](spark, third, SF)
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} <= stay
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
