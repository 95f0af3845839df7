"""Exact dedup by owners in Patricia tries (operator 7).

Texts are dealt out by length and content hash. Each task inserts the full byte strings it got
into a compressed radix trie whose terminal nodes hold the owner (one id) and the number of rows.
Two texts are equal exactly when they end in the same node, whatever their hashes say.

* Before the shuffle every task runs its rows through a trie of its own, so that a text that a third
  of all rows share crosses the shuffle once per task and not once per row.
* A trie over its byte budget spills subtrees: before the shuffle all of it, as partial owners that
  merge later; after it, where rows come sorted by text, the subtrees left of the last insertion, which no
  later row can reach. So neither a hot text nor a large partition has to fit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, claim_worker, join_owners, lower_ascii, stored, table

#: A trie's budget of text bytes; the tries of a worker never hold more than this and one text.
TRIE_BYTES = 32 << 20


class _Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.kids, self.value = label, {}, value


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class OwnerTrie:
    """A compressed radix trie from byte strings to values, merged by ``merge(old, new)``."""

    def __init__(self, merge: Callable):
        self.root, self.merge, self.bytes = _Node(b""), merge, 0

    def insert(self, text: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(text):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            kid = node.kids.get(text[at])
            if kid is None:
                node.kids[text[at]] = _Node(text[at:], value)
                self.bytes += len(text) - at + 200
                return
            rest = text[at : at + len(kid.label)]
            if rest != kid.label:
                n = _common(rest, kid.label)
                split = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                split.kids[kid.label[0]] = kid
                node.kids[text[at]] = kid = split
                self.bytes += 200
            node, at = kid, at + len(kid.label)

    @staticmethod
    def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        open_ = [(node, prefix)]
        while open_:
            node, prefix = open_.pop()
            if node.value is not None:
                yield prefix, node.value
            open_ += [(kid, prefix + kid.label) for kid in node.kids.values()]

    def spill_all(self) -> Iterator[tuple[bytes, object]]:
        root, self.root, self.bytes = self.root, _Node(b""), 0
        yield from self._walk(root, b"")

    def spill_before(self, text: bytes) -> Iterator[tuple[bytes, object]]:
        """Cut off and yield all that sorts before ``text``; only its own path stays."""
        node, at, self.bytes = self.root, 0, len(text) + 1000
        while at < len(text):
            if node.value is not None:
                yield text[:at], node.value
                node.value = None
            for first in [k for k in node.kids if k < text[at]]:
                kid = node.kids.pop(first)
                yield from self._walk(kid, text[:at] + kid.label)
            kid = node.kids.get(text[at])
            if kid is None or text[at : at + len(kid.label)] != kid.label:
                return
            node, at = kid, at + len(kid.label)


def _merger(largest: bool) -> Callable:
    """Values are (owner, rows, hash). A missing id owns a text only if no row has an id."""

    def merge(a, b):
        if a[0] is None or b[0] is None:
            owner = b[0] if a[0] is None else a[0]
        else:
            owner = max(a[0], b[0]) if largest else min(a[0], b[0])
        return owner, a[1] + b[1], a[2]

    return merge


_PARTIAL = pa.schema([("n", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64())])
_OWNERS = pa.schema([("n", pa.int64()), ("h", pa.int64()), ("sha", pa.string()), ("owner", pa.int64()), ("rows", pa.int64())])


def _batches(entries: Iterator[tuple], schema: pa.Schema, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for e in entries:
        held.append(e)
        held_bytes += len(e[2])
        if len(held) >= rows or held_bytes >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: n (bytes), h (hash), sha (SHA-256), owner (the id that stays), rows.

    ``normalise`` lower-cases A-Z. A null text counts as empty, a null id owns a text only if all ids are
    null; ``keep`` is "largest" or "smallest"; an empty table gives no rows."""
    merge = _merger(keep == "largest")

    def combine(batches):
        claim_worker()
        trie = OwnerTrie(merge)

        def entries():
            for batch in batches:
                for text, h, owner in zip(batch["text"].cast(pa.binary()), batch["h"].to_pylist(), batch["id"].to_pylist()):
                    trie.insert(text.as_py(), (owner, 1, h))
                    if trie.bytes > trie_bytes:
                        yield from trie.spill_all()
            yield from trie.spill_all()

        yield from _batches(((len(t), h, t, owner, rows) for t, (owner, rows, h) in entries()), _PARTIAL)

    def own(batches):
        claim_worker()
        trie = OwnerTrie(merge)

        def entries():
            for batch in batches:
                for text, h, owner, rows in zip(batch["text"], batch["h"].to_pylist(), batch["owner"].to_pylist(), batch["rows"].to_pylist()):
                    text = text.as_py()
                    trie.insert(text, (owner, rows, h))
                    if trie.bytes > trie_bytes:
                        yield from trie.spill_before(text)
            yield from trie.spill_all()

        yield from _batches(((len(t), h, hashlib.sha256(t).hexdigest(), owner, rows) for t, (owner, rows, h) in entries()), _OWNERS)

    rows = _keyed(docs, id_col, text_col, normalise).select("id", "text", "h")
    parts = rows.mapInArrow(combine, "n long, h long, text binary, owner long, rows long")
    return parts.repartition("n", "h").sortWithinPartitions("text").mapInArrow(own, "n long, h long, sha string, owner long, rows long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (lower_ascii(text) if normalise else text).alias("text"))
    return rows.withColumns({"n": F.octet_length("text").cast("long"), "h": F.xxhash64("text")})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise: bool = True) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A-Z) the row with the largest id stays. Null and empty texts are equal.
    Rows that repeat both id and text are one document: each gets the same result, and group_size counts all
    of them. If no row of a class has an id, keep_id is null and all of them are kept. Other columns are
    not read."""
    owners = text_classes(docs, id_col, text_col, keep, normalise)
    rows = _keyed(docs, id_col, text_col, normalise).select("id", "n", "h", F.sha2("text", 256).alias("sha"))
    return join_owners(rows, owners.withColumn("n_rows", F.col("rows")), ["n", "h", "sha"], "n_rows").select(
        F.col("id").alias(id_col), F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"), F.col("id").eqNullSafe(F.col("owner")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", batch: str = "8m") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns, whatever their names. A row that repeats the id and the
    text of the kept row is not a second document, and goes too: of those that differ in other columns the one with the least
    hash of these stays. Rows without an id in a class without any are all kept. An empty table gives no rows.

    The classes, without their texts, are stored first, so texts go to Python ``batch`` bytes at a time whatever the session's setting."""
    owners = stored(text_classes(docs, id_col, text_col, keep).select("n", "h", "sha", "owner", "rows"), "exact-owners", batch)
    # the given columns travel in a struct, so no name can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [c for c in docs.columns if not _holds_map(docs.schema[c].dataType)]
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("tie"))
    # of a class only the rows with its owner's id are joined, so a hot text's rows meet no single task
    kept = rows.join(owners, (rows["n"] == owners["n"]) & (rows["h"] == owners["h"]) & (rows["sha"] == owners["sha"]) & rows["id"].eqNullSafe(owners["owner"]))
    # only classes of several rows can hold a repeated id; the others pass without a second shuffle
    several = (F.col("rows") > 1) & F.col("id").isNotNull()
    single = kept.filter(~several).select("row")
    repeated = kept.filter(several).select("id", rows["sha"].alias("sha"), "tie", "row").groupBy("id", "sha").agg(F.min_by("row", "tie").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


def _holds_map(kind) -> bool:
    return "map<" in kind.simpleString()


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
