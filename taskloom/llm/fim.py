"""Fill-in-the-middle transformation (operator 11).

A text is cut at two of its units (lines, or characters) into prefix, middle and suffix, which are written out anew with
markers before each. The cuts of all rows of an Arrow batch are found together, on the batch's UTF-8 buffer:

* a table of 256 classes says of each byte whether it ends a line or begins a character;
* a mask over adjacent bytes says where a unit ends: after a line end, before a character, and at the end of each text;
* its cumulative sum, less the sum at the text's start, numbers the units of each text anew;
* a cut after k units of a text is where the cumulative sum reaches the text's start plus k: one ``searchsorted`` for all rows.

Whether a text has markers of its own is a mask over three adjacent bytes. Numbers that decide come from the SHA-256 of a
seed and the row's id, by Spark. Batches are cut into slices of ``SLICE_BYTES`` (or one text), so a worker's memory
follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import claim_worker, free_name, table

#: Fixed values of the form: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Bytes of text that are worked on at a time.
SLICE_BYTES = 8 << 20

_LINE_END, _CHAR = 1, 2
_CLASS = np.full(256, _CHAR, np.uint8)
_CLASS[0x80:0xC0] = 0  # continuation bytes begin no character
_CLASS[0x0A] |= _LINE_END


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of neighbouring rows with at most ``size`` bytes of text, or of one row."""
    texts = batch[column]
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each begins, with the end of the last one)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


class Units:
    """The units of all texts in a buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str = "line"):
        self.data, self.starts = data, starts
        self.classes = _CLASS[data]
        if unit == "line":
            last = (self.classes & _LINE_END).astype(bool)  # a unit's last byte
        else:
            last = np.zeros(len(data), bool)
            last[:-1] = (self.classes[1:] & _CHAR).astype(bool)
        full = starts[1:] > starts[:-1]
        last[starts[1:][full] - 1] = True
        # one before the first byte, so that the sum at a place is of what lies before it
        self.sums = np.concatenate([np.zeros(1, np.int32 if len(data) < 1 << 31 else np.int64), np.cumsum(last, dtype=np.int32 if len(data) < 1 << 31 else np.int64)])
        self.before = self.sums[starts]
        self.counts = np.diff(self.before).astype(np.int64)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Where the first ``k`` units of each text end."""
        return np.maximum(np.searchsorted(self.sums, self.before[:-1] + k, "left"), self.starts[:-1])

    def chars(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Characters between two places of each text."""
        heads = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.classes >> 1, dtype=np.int64)])
        return heads[end] - heads[begin]

    def marked(self) -> np.ndarray:
        """Which texts contain a marker."""
        d = self.data
        out = np.zeros(len(self.starts) - 1, bool)
        if len(d) > 2:
            letter = np.zeros(256, bool)
            letter[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True
            at = np.flatnonzero((d[:-2] == ord("<")) & (d[2:] == ord(">")) & letter[d[1:-1]])
            row = np.searchsorted(self.starts, at, "right") - 1
            out[row[at + 2 < self.starts[row + 1]]] = True
        return out


def transform(texts: pa.Array, hashes: np.ndarray, unit: str, rate: int, spm_rate: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of texts without nulls; ``hashes`` has four numbers per text."""
    data, starts = buffer_of(texts)
    units = Units(data, starts, unit)
    n = units.counts
    places = np.sort(hashes[:2] % (n + 1), axis=0)
    first, second = units.cut(places[0]), units.cut(places[1])
    plain = (n == 0) | units.marked() | (hashes[2] % 100 >= rate)
    spm = hashes[3] % 100 < spm_rate
    # five strings in a row with markers between: the first begins at the text's start, and so on
    begins, ends = starts[:-1], starts[1:]
    raw, out = data.data, []
    for is_plain, is_spm, a, b, c, d in zip(plain.tolist(), spm.tolist(), begins.tolist(), first.tolist(), second.tolist(), ends.tolist()):
        if is_plain:
            out.append(raw[a:d])
        elif is_spm:
            out.append(b"".join((_MARK[1], raw[c:d], _MARK[0], raw[a:b], _MARK[2], raw[b:c])))
        else:
            out.append(b"".join((_MARK[0], raw[a:b], _MARK[1], raw[c:d], _MARK[2], raw[b:c])))
    return [
        pa.array(n), pa.array(np.where(plain, PLAIN, np.where(spm, SPM, PSM))), pa.array(units.chars(begins, first), mask=plain), pa.array(units.chars(first, second), mask=plain),
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


_MARK = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output, in new columns with underscores before a name that is taken.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of these with the suffix first; ``unit`` is "line" or "char".
    A null text is empty; empty texts and those that contain a marker stay plain. Rows without an id count as having an
    empty one, so they share their numbers, as rows with equal ids do. Other columns pass through, and an empty table gives no rows."""
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    taken = list(docs.columns)
    new = {}
    for c in ("n", "form", "prefix_chars", "middle_chars", "output"):
        new[c] = free_name(c, [*taken, *new.values()])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    h = free_name("h", [*taken, *new.values()])
    given = docs.withColumns({h: F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]), text_col: F.coalesce(F.col(text_col).cast("string"), F.lit(""))})
    kinds = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("fim")
        for batch in batches:
            for part in text_slices(batch, text_col):
                hashes = np.asarray(part[h].flatten(), np.int64).reshape(-1, 4).T
                kept = part.drop_columns([h])
                made = transform(part[text_col], hashes, unit, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, *new.values()])

    columns = given.drop(h).schema.fields
    return given.mapInArrow(work, T.StructType([*[T.StructField(f.name, f.dataType) for f in columns], *[T.StructField(new[c], t) for c, t in kinds]]))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form. No text that was transformed has a marker, so each stands in its output once."""
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    end = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == PSM, F.concat(between(PREFIX, SUFFIX), end, between(SUFFIX, MIDDLE)))
        .when(form == SPM, F.concat(between(PREFIX, MIDDLE), end, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, string_split(text, chr(10)) AS parts FROM d),
n AS (SELECT *, CASE WHEN text = '' THEN 0 WHEN ends_with(text, chr(10)) THEN len(parts) - 1 ELSE len(parts) END::BIGINT AS n FROM u),
c AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
        text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 AS plain, ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm FROM n),
k AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM c),
-- the first i of the lines, each with its line end but for the last one of a text that has none
s AS (SELECT *, CASE WHEN lo = 0 THEN '' WHEN lo = n THEN text ELSE array_to_string(parts[1:lo], chr(10)) || chr(10) END AS prefix,
        CASE WHEN hi = 0 THEN '' WHEN hi = n THEN text ELSE array_to_string(parts[1:hi], chr(10)) || chr(10) END AS upto FROM k),
p AS (SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(text, length(upto) + 1) AS suffix FROM s)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
