"""Language identification by mixture inference (operator 4).

A language is a distribution over hashed byte trigrams, learned from labelled documents. A document is a
mixture: expectation-maximisation estimates the share of each language from the likelihoods of its
trigrams. Which languages take part is chosen by penalised likelihood: starting from all, the language with the
least share leaves as long as the likelihood lost costs less than the penalty saved (BIC). The language with
the largest share is the prediction and its share the score.

The model is a table of fixed size per language. It is fitted on a bounded sample of the labelled documents
(``per_language``, chosen by a hash of the id); predictions read every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import claim_worker, free_name, table

#: Hash buckets of trigrams, a power of two.
BUCKETS = 1 << 15
#: Labelled documents per language that the model is fitted on, roughly.
PER_LANGUAGE = 2000
#: Steps of expectation-maximisation.
STEPS = 12
#: Trigrams overlap: each byte is in three, so a third of their number counts as independent.
OVERLAP = 3

UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
_SMALL = np.arange(256, dtype=np.uint32)
_SMALL[65:91] += 32


def trigram_counts(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the text's byte trigrams with a letter in the middle, A-Z in lower case, framed by spaces."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    b = _SMALL[raw]
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - (buckets.bit_length() - 1))
    return np.bincount(h[_LETTER[raw[1:-1]]], minlength=buckets)


def infer(counts: np.ndarray, logs: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Shares of the languages (rows of ``logs``, log probabilities by bucket) in a document."""
    seen = np.flatnonzero(counts)
    languages = np.arange(len(logs))
    shares = np.zeros(len(logs))
    if not len(seen):
        return shares
    c, lp = counts[seen].astype(np.float64), logs[:, seen]
    top = lp.max(axis=0)
    p = np.exp(lp - top)
    total = c.sum()
    penalty = 0.5 * np.log(max(total, 2.0)) * OVERLAP

    def fit(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(steps):
            w = w * (p @ (c / np.maximum(w @ p, 1e-300))) / total
        return w, float(c @ np.log(np.maximum(w @ p, 1e-300)))

    w, fitted = fit(p, np.full(len(p), 1.0 / len(p)))
    while len(languages) > 1:
        stay = np.arange(len(languages)) != w.argmin()
        w2, fitted2 = fit(p[stay], w[stay] / w[stay].sum())
        if fitted - fitted2 > penalty:
            break
        languages, p, w, fitted = languages[stay], p[stay], w2, fitted2
    shares[languages] = w
    return shares


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Labelled documents whose CRC-32 of the id, as text, is no multiple of 5; ``held_out`` are the others."""
    return docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_languages(rows: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities) from id, text, lang.

    Counts per language decide a share of rows to take, by a hash of id and text; the trigrams of those are
    counted in the tasks and summed per language. The driver gets one table of ``buckets`` numbers per language."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not sizes:
        return [], np.zeros((0, buckets), np.float32)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(per_language / n))])[F.col("lang")]
    picked = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary())):
                sums[lang] = sums.get(lang, 0) + trigram_counts(text.as_py(), buckets)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())], schema=schema)

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in group["counts"])
        return pa.Table.from_arrays([pa.array([group["lang"][0].as_py()]), pa.array([total.tobytes()], pa.binary())], schema=schema)

    tables = picked.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    tables = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in tables)
    if not tables:
        return [], np.zeros((0, buckets), np.float32)
    n = np.stack([t for _, t in tables]).astype(np.float64) + 0.1
    return [lang for lang, _ in tables], np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, languages: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, the columns ``keep``, lang_pred, score and mixture ("en:0.93 fr:0.07"); where a column
    that is kept has one of these three names, the new one begins with an underscore.

    A null text, one without letters, or a model without languages gives ``und`` with score 0 and no mixture. Equal
    shares go to the first language by name. Ids and labels are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, logs))
    names = {f"__k{i}": k for i, k in enumerate(keep or [])}
    carried = [F.col(k).alias(n) for n, k in names.items() if k != text_col]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"), *carried)
    kinds = {f.name: f.dataType for f in rows.schema} | {n: StringType() for n, k in names.items() if k == text_col}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker()
        languages, logs = shared.value
        for batch in batches:
            langs, scores, mixtures = [], [], []
            for text, letters in zip(batch["__text"].cast(pa.binary()), batch["__letters"].to_pylist()):
                shares = infer(trigram_counts(text.as_py(), logs.shape[1]), logs) if letters and languages else None
                if shares is None or not shares.any():
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    mixtures.append(None)
                    continue
                best = int(shares.argmax())
                langs.append(languages[best])
                scores.append(min(1.0, float(shares[best])))
                mixtures.append(" ".join(f"{languages[i]}:{shares[i]:.2f}" for i in np.argsort(-shares, kind="stable") if shares[i] > 0))
            fixed = [batch["__text" if k == text_col else n] for n, k in names.items()]
            yield pa.RecordBatch.from_arrays([batch["__id"], *fixed, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.string())], ["__id", *names, "lang_pred", "score", "mixture"])

    schema = StructType([StructField("__id", kinds["__id"]), *(StructField(n, kinds[n]) for n in names), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", StringType())])
    found = rows.mapInArrow(predict, schema)
    kept = [id_col, *names.values()]
    return found.select(F.col("__id").alias(id_col), *[F.col(n).alias(k) for n, k in names.items()], *[F.col(c).alias(free_name(c, kept)) for c in ("lang_pred", "score", "mixture")])


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the predicted language in ``lang_col``, without the documents whose language is unknown (no text or
    no letters). Where no document has a label there is no model: labels stay, texts without letters go."""
    languages, logs = fit_languages(training_rows(docs, id_col, text_col, lang_col))
    if not languages:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    others = [c for c in docs.columns if c not in (id_col, lang_col)]
    found = identify(docs, languages, logs, id_col, text_col, others)
    new = F.col(free_name("lang_pred", [id_col, *others]))
    return found.filter(new != UNKNOWN).select(*[new.alias(c) if c == lang_col else F.col(c) for c in docs.columns])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, logs = fit_languages(training_rows(docs))
    return identify(docs, languages, logs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
