"""Fill-in-the-middle, BPE with word ends and vector codes against plain versions, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n string, form string, output string, h long, lang string"


def documents(spark, rows):
    """With columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "n", "f", "o", 5, None) for i, t in rows], SCHEMA).repartition(3)


def some_texts(seed=1):
    rng = random.Random(seed)
    pieces = ["a", "é", "漢", "\n", "\n\n", " ", "<P>", "<S", "M>", "x\r", "😀", "word ", "<<M>>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(150)]
    return [*enumerate(texts), (None, "no id\nb\n"), (None, "no id\nb\n"), (3, texts[3]), (-5, None), (900, ""), (901, "\n" * 5000), (902, "é" * 300_000), (903, "long line\n" * 100_000 + "end")]


# 11


def plain_fim(doc_id, text, unit="line", seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,rate", [("line", 100), ("char", 60)])
def test_fill_in_middle(spark, unit, rate):
    from taskloom.llm.fim import fill_in_middle, restored

    rows = some_texts()
    made = fill_in_middle(documents(spark, rows), rate=rate, unit=unit)
    assert made.columns == ["doc_id", "text", "n", "form", "output", "h", "lang", "_n", "_form", "prefix_chars", "middle_chars", "_output"]
    made = made.withColumn("back", restored(F.col("_output"), F.col("_form")))
    got = sorted(((r["doc_id"], r["text"], r["n"], r["h"], *(r[c] for c in ("_n", "_form", "prefix_chars", "middle_chars", "_output", "back"))) for r in made.collect()), key=str)
    assert got == sorted(((i, t or "", "n", 5, *plain_fim(i, t, unit, rate=rate), t or "") for i, t in rows), key=str)
    assert fill_in_middle(documents(spark, []), unit=unit).count() == 0


def test_slices_follow_bytes():
    import pyarrow as pa

    from taskloom.llm.fim import text_slices

    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", None, "", "bb", "cccccccccc", "d"]})
    assert [s["text"].to_pylist() for s in text_slices(batch, "text", 5)] == [["aaaa", None, ""], ["bb"], ["cccccccccc"], ["d"]]


# 12


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_bpe(spark, library):
    from taskloom.llm.word_bpe import public_vocabulary, tokenize

    rng = random.Random(2)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|", "ΟΔΟΣ", "İ", "é", "é", "가", "it's", "WE'LL", " ", "\n", "123", "ß", "\x1c", "\x85", "漢字", "👩‍👩", "!!", "Ɤ", "Ᲊ", "unbelievable", "the"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(300)] + ["".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id"), (None, "no id"), (3, texts[3]), (-1, None), (900, ""), (901, "a" * 200_000), (902, "Lorem ipsum é " * 40_000), (903, " \n")]
    encoded = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    shown = [library.decode(e, skip_special_tokens=False) for e in encoded]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = sorted(((i, len(e), sha(" ".join(map(str, e))), sha(d), e, d) for (i, _), e, d in zip(rows, encoded, shown)), key=str)
    # also with words that are forgotten all the time
    for bounds in ({}, {"kept_words": 5, "slice_bytes": 100}):
        out = tokenize(documents(spark, rows), public_vocabulary(), **bounds)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        assert sorted((tuple(r) for r in out.collect()), key=str) == wanted
    assert tokenize(documents(spark, []), public_vocabulary()).count() == 0


def test_one_character_at_a_time(library):
    from taskloom.llm.word_bpe import Splitter, Vocabulary, Words, _texts, public_vocabulary

    v = Vocabulary(public_vocabulary())
    chars = [chr(c) for c in [*range(0x800), *range(0x800, 0xD800, 7), *range(0xE000, 0x110000, 501)]]
    texts = [f"a{c}b {c}{c}" for c in chars]
    n, ids, shown = _texts(Words(v), Splitter(v), texts)
    for t, k, i, s, e in zip(texts, n, ids, shown, library.encode_batch(texts, add_special_tokens=False)):
        assert (k, bytes(i).decode(), bytes(s).decode()) == (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)), t


def test_shared_prefixes_are_walked_once():
    from taskloom.llm.word_bpe import Trie, Vocabulary, public_vocabulary

    trie = Trie(Vocabulary(public_vocabulary()))
    words = [b"interest", b"interested", b"interesting", b"internal"]
    assert len(list(trie.insert(words))) == 4
    # the root, each distinct prefix once, and an end per word
    assert len(trie.last) == 1 + len({w[:i] for w in words for i in range(1, len(w))}) + 4


# 13


def plain_codes(rows, parts, entries, rounds, scale=256):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in kept], np.float32).astype(np.float64) * scale).astype(np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    code, d = assign()
    error = d.sum(1)
    label_error = {}
    for (_, _, label), e in zip(kept, error):
        label_error[label] = label_error.get(label, 0) + int(e)
    return sorted(((i, "".join(f"{c:02x}" for c in row), int(e), label_error[label]) for (i, _, label), row, e in zip(kept, code, error)), key=str), books


@pytest.mark.parametrize("dim,parts,entries", [(16, 4, 8), (12, 4, 5), (4, 4, 64), (40, 2, 16)])
def test_vector_codes(spark, dim, parts, entries):
    from taskloom.llm.vector_codes import compressed, decoded

    rng = np.random.default_rng(dim)
    vector = lambda: [float(np.float32(v)) for v in rng.choice([rng.normal(), 0.0, 0.25, -3.0, 1e-9], dim)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(300)]
    rows += [rows[7], rows[7], (None, vector(), 2), (None, vector(), None), (5, vector(), 0), (1000, None, 0), (1001, [None] + vector()[1:], 0), (1002, [float("nan")] + vector()[1:], 0), (1003, [float("-inf")] + vector()[1:], 9)]
    rows = [(i, v, None if label is None else int(label)) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, vector string").repartition(3)
    out, books = compressed(df, parts, entries)
    wanted, wanted_books = plain_codes(rows, parts, entries, 2)
    assert (books == wanted_books).all()
    assert out.columns == ["vec_id", "code", "error", "label_error"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == wanted
    r = out.select("code", decoded(F.col("code"), books).alias("v")).first()
    assert r["v"] == [float(x) / 256 for p in range(parts) for x in books[p, int(r["code"][2 * p : 2 * p + 2], 16)]]
    empty, none = compressed(df.filter("vec_id = 1000"), parts, entries)
    assert empty.count() == 0 and none.size == 0


def test_bounds_never_lose_the_nearest():
    from taskloom.llm.vector_codes import nearest

    rng = np.random.default_rng(5)
    for width, spread in ((1, 3), (3, 1 << 20), (4, 40), (7, 2), (16, 1 << 25)):
        x, e = rng.integers(-spread, spread + 1, (700, width)), rng.integers(-spread, spread + 1, (64, width))
        e[40:50] = e[:10]
        x[:30] = x[0]
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        code, least = nearest(x, e)
        assert (code == d.argmin(1)).all() and (least == d.min(1)).all()


def test_vectors_that_cannot_be_compared(spark):
    from taskloom.llm.vector_codes import compressed

    df = spark.createDataFrame([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="all have to have 4"):
        compressed(df, 4, 2)[0].collect()
    with pytest.raises(ValueError, match="equal parts"):
        compressed(df, 3, 2)


# what earlier operators had open


def test_equal_rows_are_dealt_out(spark):
    from taskloom.llm import sharding

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"), F.lit(1).alias("__n"), F.lit(2).alias("copies"))
    out = sharding.shard(rows)
    got = out.select("doc_id", "shard", "slot", "row_number").collect()
    assert len(got) == 30_000 and sorted(r["row_number"] for r in got) == list(range(30_000))
    assert len({(r["shard"], r["slot"]) for r in got}) == 30_000
    # a third of all rows is one kind, and no task makes them all
    assert out.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("doc_id").isNull()).alias("n")).agg(F.max("n")).first()[0] < 9_000
    kinds = sharding.row_numbers(spark.createDataFrame([(None, 5), (1, 2), (2, 1)], "id long, c long"), ["id"], copies="c").collect()
    assert sorted((r["row_number"], r["c"]) for r in kinds)[0][0] == 0 and {r["n_rows"] for r in kinds} == {8}
    ends = sorted((r["row_number"], r["row_number"] + r["c"]) for r in kinds)
    assert [e[1] for e in ends[:-1]] == [e[0] for e in ends[1:]] and ends[-1][1] == 8


def test_slices_do_not_go_by_the_order_of_rows(spark):
    from taskloom.llm._common import join_owners

    rows = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"))
    owners = rows.groupBy("k").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n"))
    wanted = {(r["id"], r["owner"]) for r in rows.join(owners, "k").collect()}
    plan = join_owners(rows, owners, ["k"], "n")._jdf.queryExecution().analyzed().toString()
    assert "monotonically" not in plan and "xxhash64" in plan
    for order in ("id", F.desc("id"), F.rand(1)):
        got = join_owners(rows.repartition(5).sortWithinPartitions(order), owners, ["k"], "n").collect()
        assert len(got) == 60_000 and {(r["id"], r["owner"]) for r in got} == wanted


def test_archives_lie_wherever_spark_writes(monkeypatch):
    from pyarrow import fs

    from taskloom.llm import warc

    asked = []
    real = fs.FileSystem.from_uri
    monkeypatch.setattr(warc.fs, "FileSystem", type("FileSystem", (), {"from_uri": staticmethod(lambda u: asked.append(u) or (real(u) if u.startswith("file") or "://" not in u or u.startswith("dbfs") else (None, u)))}))
    for folder in ("s3a://bucket/k", "s3n://bucket/k", "hdfs://host/k", "gs://bucket/k", "viewfs://store/k"):
        warc.opened(folder)
    assert asked == ["s3://bucket/k", "s3://bucket/k", "hdfs://host/k", "gs://bucket/k", "viewfs://store/k"]
    for folder in ("/tmp/k", "file:/tmp/k", "file:///tmp/k"):
        assert warc.opened(folder)[1] == "/tmp/k"
    with pytest.raises(ValueError, match="dbfs"):
        warc.opened("dbfs:/k")


def test_warc_with_clashing_names_and_a_long_payload(spark):
    import base64

    from taskloom.llm import warc
    from taskloom.llm._common import work_dir

    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij é") for _ in range(9 << 20))
    rows = [(1, "u", long), (2, None, None), (3, "u", "x"), (4, "u", "x"), (None, "u", "y"), (5, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("payload", "sha", "size", "owner", "n", "record_type", "refers_to")})
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages, work_dir(spark, "warc")).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in got.items()} == {i: (len((t or "").encode()), sha(t)) for i, _, t in rows}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 5), 3: ("revisit", 4), 4: ("response", None), None: ("response", None), 5: ("response", None)}


def test_chat_with_clashing_names(spark):
    from taskloom.llm import chat

    m = chat.train(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    rows = spark.createDataFrame([(1, 0, "user", "User: why\nso"), (1, 1, "assistant", "because"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    plain = sorted(map(str, chat.parse(rows, m).collect()))
    clash = rows.withColumns({c: F.lit("x") for c in ("given", "conv", "copy", "rep", "place", "segment", "line", "body", "state")})
    assert sorted(map(str, chat.parse(clash, m).collect())) == plain and plain


def test_long_texts_pass_the_other_operators(spark):
    from taskloom.llm import bpe, langid, mixing, sharding

    long = "the quick brown fox jumps over the lazy dog " * 30_000
    rows = spark.createDataFrame([(i, f"{i} {long}" if i < 2 else "short text here", "en", f"s{i % 2}", 1) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix(rows, total=3.0).filter(F.length("text") > 10**6).count() > 0
    assert sorted(r["size"] for r in sharding.shard(rows).collect())[-1] == len(long) + 3
    ranks, pattern = bpe.public_ranks()
    out = {r["doc_id"]: r for r in bpe.tokenize(rows, ranks, pattern, with_ids=False).collect()}
    assert out[0]["n_tokens"] > 200_000 and out[0]["decoded_sha256"] == hashlib.sha256(f"0 {long}".encode()).hexdigest()
    assert langid.keep_identified(rows).count() == 10
