"""Vector code compression: product quantisation in whole numbers (operator 13).

A vector becomes whole numbers floor(scale * x), is cut into equal parts, and each part is replaced by the index of its
nearest entry in that part position's codebook. Codebooks start as the parts of the vectors with the least ids and
are refined by rounds of assignment and floor(mean).

The nearest entry is found by segment-mean lower bounds, from coarse to fine. A part is cut into 1, 2, 4, ... blocks. Of
each block only the mean and the norm of what differs from the mean (the residual) are looked at: by Cauchy-Schwarz

    |x - e|^2  >=  sum over blocks of  m (mean x - mean e)^2 + (residual norm x - residual norm e)^2

The coarsest bound is taken for all entries, the exact distances of the few that it favours bound the nearest one from above, and
entries whose lower bound is above that are out; each finer level looks at what is left. Sums and residuals are exact whole numbers
and what rounding can add to a bound is taken off, so the true nearest entry is never out. Survivors get exact distances.

Spark deals out the rows: each task sums up the parts of each entry, at most parts x entries rows a task leave it, and
only the sums of codebooks (parts x entries x width numbers, whatever the number of rows) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import claim_worker, join_owners, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of which the bounds are taken at a time: as many times the entries are numbers in memory.
SLAB = 4096
#: Entries favoured by the coarsest bound whose exact distances bound the nearest one from above.
SEEDS = 8
#: Largest whole number of a component: products of three such sums stay below 2^63.
MOST = 1 << 26


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, infinite or not a number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def whole(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of ``width`` whole numbers."""
    lengths = np.diff(np.asarray(vectors.offsets))
    if len(vectors) and (lengths != width).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} components; all have to have {width}")
    x = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"components above {MOST} / {scale} are too large for exact distances")
    return x.astype(np.int64).reshape(len(vectors), width)


def _levels(width: int) -> list[list[slice]]:
    """Blocks from one to all components by halving; single components are left to the exact distance."""
    levels, n = [], 1
    while n < width or n == 1:
        edges = [width * i // n for i in range(n + 1)]
        levels.append([slice(a, b) for a, b in zip(edges, edges[1:]) if b > a])
        n *= 2
    return levels


class _Blocks:
    """Rows of whole numbers, and per level points whose distances bound theirs from below: of each block the mean and the
    residual's norm, the mean times the root of the block's size."""

    def __init__(self, x: np.ndarray):
        self.x, self.square = x, (x * x).sum(1)
        self.levels = []
        for blocks in _levels(x.shape[1]):
            points = []
            for b in blocks:
                size, own = b.stop - b.start, x[:, b]
                total = own.sum(1)
                # size * sum x^2 - (sum x)^2 is whole and exact, so a norm has the rounding of one root only
                points += [total / np.sqrt(size), np.sqrt((size * (own * own).sum(1) - total * total) / size)]
            self.levels.append(np.stack(points, 1) if points else np.zeros((len(x), 0)))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry of each row, the squared distance), ties to the lower index."""
    found = [_nearest(x[a : a + SLAB], _Blocks(entries)) for a in range(0, len(x), SLAB)]
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64),) * 2


def _nearest(x: np.ndarray, e: _Blocks) -> tuple[np.ndarray, np.ndarray]:
    rows = _Blocks(x)

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = x[i] - e.x[j]
        return np.einsum("ij,ij->i", d, d)

    # all entries by one block
    coarse, to = rows.levels[0], e.levels[0]
    bound = np.zeros((len(x), len(e.x)))
    for c in range(coarse.shape[1]):
        d = coarse[:, c, None] - to[None, :, c]
        d *= d
        bound += d
    # what rounding can have added
    bound -= 1e-12 * (rows.square[:, None] + e.square[None, :]) + 1
    seeds = min(SEEDS, len(e.x))
    tried = np.argpartition(bound, seeds - 1, 1)[:, :seeds]
    most = exact(np.repeat(np.arange(len(x)), seeds), tried.ravel()).reshape(-1, seeds).min(1)
    i, j = np.nonzero(bound <= most[:, None])
    # what is left by finer blocks; the entry that each level favours may be nearer than those before
    for near, to in zip(rows.levels[1:], e.levels[1:]):
        d = near[i] - to[j]
        fine = np.einsum("ij,ij->i", d, d) - (1e-12 * (rows.square[i] + e.square[j]) + 1)
        first = np.flatnonzero(np.diff(i, prepend=-1))  # pairs are in the order of rows, and each row has one
        best = np.flatnonzero(fine == np.minimum.reduceat(fine, first)[i]) if len(first) else first
        np.minimum.at(most, i[best], exact(i[best], j[best]))
        left = fine <= most[i]
        i, j = i[left], j[left]
    d = exact(i, j)
    first = np.flatnonzero(np.diff(i, prepend=-1))
    least = np.minimum.reduceat(d, first) if len(first) else d
    hit = np.flatnonzero(d == least[i])
    hit = hit[np.flatnonzero(np.diff(i[hit], prepend=-1))]  # pairs of a row are in the order of entries
    return j[hit], d[hit]


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """parts x entries x width numbers: the parts of the ``entries`` usable rows (id, vector) with the least ids, null ids last.

    Of rows with equal ids the lesser vector counts first; with fewer rows there are fewer entries."""
    top = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"].combine_chunks()
    width = len(top[0]) if len(top) else 0
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    x = whole(top, width, scale)
    return np.ascontiguousarray(x.reshape(len(x), parts, width // parts).swapaxes(0, 1))


def refined(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Each entry replaced by floor(mean) of the parts that are nearest to it; one without parts stays."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("vector_codes")
        books, total, count = shared.value, np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = whole(batch["vector"], parts * width, scale)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                code, _ = nearest(own, books[p])
                np.add.at(total[p], code, own)
                count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": p, "entry": e, "n": count[p, e], "total": list(total[p, e])}, schema=pa.schema([("part", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    partial = vectors.select("vector").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    # a number per place of an entry, so as many rows as the codebooks have numbers
    added = partial.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    out = books.copy()
    if width:
        at = tuple(np.asarray(added[c]) for c in ("part", "entry", "at"))
        out[at] = np.asarray(added["x"]) // np.asarray(added["n"])
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks of usable rows (id, vector); see ``first_codebooks`` and ``refined``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so there are 1 to 256 entries")
    books = first_codebooks(vectors, parts, entries, scale)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(vectors, books, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vectors`` with code and error in place of ``vector``: two hexadecimal digits a part, and the squared distances summed up."""
    parts, _, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("vector_codes")
        for batch in batches:
            x = whole(batch["vector"], parts * width, scale)
            codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], d = nearest(x[:, p * width : (p + 1) * width], shared.value[p])
                error += d
            rest = batch.drop_columns(["vector"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(["".join(r) for r in digits[codes].tolist()], pa.string()), pa.array(error)], [*rest.schema.names, "code", "error"])

    return vectors.mapInArrow(work, T.StructType([*[f for f in vectors.schema.fields if f.name != "vector"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decoded(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) for e in book]) for book in books])
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.flatten(F.array(*[F.get(F.get(entries, F.lit(p)), at(p)) for p in range(len(books))]))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id_col, code, error, label_error; the codebooks). ``label_error`` is the error summed over rows with the same label, nulls together.

    Rows whose vector is not ``usable`` are left out; null ids come last among those that begin the codebooks; repeated rows
    are each coded; vectors of other lengths than the rest raise. An empty table, or one without usable rows, gives no rows
    and no entries. Other columns are not read."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")))
    books = train(given, parts, entries, rounds, scale)
    named = given.select("id", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), "vector")
    coded = stored(encode(named, books, scale), "vector-codes")
    owners = coded.groupBy("no_label", "label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    rows = join_owners(coded, owners, ["no_label", "label"], "n")
    return rows.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("codebooks_sha256", F.lit(digest(books)))


def _assigned(name: str, books: str) -> str:
    """A CTE with each part's nearest entry ``e`` and its distance ``d``."""
    return f"""{name} AS (SELECT id, p, (min(d * {ENTRIES} + e) % {ENTRIES})::BIGINT AS e, (min(d * {ENTRIES} + e) // {ENTRIES})::BIGINT AS d
  FROM (SELECT x.id, x.p, c.e, list_sum([(x.a[i] - c.a[i]) * (x.a[i] - c.a[i]) FOR i IN range(1, len(x.a) + 1)])::BIGINT AS d FROM x JOIN {books} c ON c.p = x.p) GROUP BY id, p)"""


def _refined(name: str, books: str, assigned: str) -> str:
    return f"""{name} AS (SELECT c.p, c.e, coalesce(m.a, c.a) AS a FROM {books} c LEFT JOIN (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS a
  FROM (SELECT x.p, t.e, i, sum(x.a[i])::BIGINT AS s, count(*) AS n FROM x JOIN {assigned} t ON t.id = x.id AND t.p = x.p, range(1, len(x.a) + 1) r(i) GROUP BY x.p, t.e, i) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"""


OP13_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, [floor({SCALE} * v::DOUBLE)::BIGINT FOR v IN embedding] AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
x AS MATERIALIZED (SELECT id, p, a[p * (len(a) // {PARTS}) + 1 : (p + 1) * (len(a) // {PARTS})] AS a FROM k, range({PARTS}) r(p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, a FROM x WHERE id <= {ENTRIES}),
{_assigned("a1", "b0")}, {_refined("b1", "b0", "a1")}, {_assigned("a2", "b1")}, {_refined("b2", "b1", "a2")}, {_assigned("a3", "b2")},
r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(a, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT k.vec_id, r.code, r.error, (sum(r.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256 FROM k JOIN r ON r.id = k.id, h
"""
