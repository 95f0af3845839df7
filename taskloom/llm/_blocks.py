"""Blocks of documents, and which keys of a block other documents have too.

Two operators need to know which of very many small keys (shingles, anchors) occur in more than one
document, and need the texts of the documents again afterwards. Their texts are written once, as blocks of
a few MB, compressed, one row per block, in the folder that all executors share. Later passes join what they
learnt to the blocks by the block's number; a block fits in memory whatever the size of the corpus.

``shared_keys`` deals the keys of each block out to buckets, as packed arrays of 32-bit numbers, each key once per
block. So a key that a third of all documents have costs a few bytes per block, and a bucket's size is a
matter of how many buckets there are. The bucket's number and the 32 bits together name a key; that
two keys share a name only makes an operator look at more candidates, as each compares the real thing later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, claim_worker, join_owners, shuffle_partitions, stored

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Blocks whose keys one bucket counts at once.
SLICE_BLOCKS = 4096
#: Keys that one bucket holds, roughly.
BUCKET_KEYS = 1 << 20

_BLOCK = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("missing", pa.binary()), ("lens", pa.binary()), ("digests", pa.binary()), ("data", pa.binary())])
_BLOCK_SQL = "block long, n_bytes long, ids binary, missing binary, lens binary, digests binary, data binary"
_KEYS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_KEYS_SQL = "bucket int, block long, keys binary, counts binary"


def block_table(docs: DataFrame, id_col: str, text_col: str, tag: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n_bytes, ids, missing, lens, digests (16 bytes per text), data: the texts (null: empty) of all rows, as stored blocks.
    Where the byte in ``missing`` is 1, an id is null; its place in ``ids`` has NO_ID."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker()
        first, n = TaskContext.get().partitionId() << 32, 0
        press = zstandard.ZstdCompressor(level=1)

        def block(ids: list, texts: list) -> pa.RecordBatch:
            lens = np.array([len(t) for t in texts], np.int64)
            row = [[first + n], [int(lens.sum())], [np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes()], [bytes(i is None for i in ids)], [lens.tobytes()], [b"".join(map(xxhash.xxh3_128_digest, texts))], [press.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _BLOCK.types)], schema=_BLOCK)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary())):
                t = t.as_py()
                if texts and size + len(t) > block_bytes:
                    yield block(ids, texts)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield block(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(pack, _BLOCK_SQL), tag, compression="uncompressed")


class Block:
    """A row of the block table, unpacked."""

    __slots__ = ("block", "ids", "missing", "lens", "ends", "starts", "data")

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids, self.lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
        self.missing = row["missing"]
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.data = zstandard.ZstdDecompressor().decompress(row["data"]) if row["n_bytes"] else b""

    def real_ids(self) -> list[int | None]:
        """The ids as they were given; where they are compared, a missing one stands as NO_ID, the largest."""
        return [None if m else i for i, m in zip(self.ids.tolist(), self.missing)]

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            yield self.data[a:b]


def later_copies(blocks: DataFrame) -> DataFrame:
    """block, row: the rows whose text a smaller id has, too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, digests in zip(*(batch[c].to_pylist() for c in ("block", "ids", "digests"))):
                n = len(ids) // 8
                columns = [pa.array([block] * n), pa.array(range(n), pa.int32()), pa.array(np.frombuffer(ids, np.int64)), pa.array([digests[16 * i : 16 * i + 16] for i in range(n)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "row", "doc", "digest"])

    each = blocks.select("block", "ids", "digests").mapInArrow(rows, "block long, row int, doc long, digest binary")
    least = each.groupBy("digest").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_owners(each, least, ["digest"], "n").filter("doc > least").select("block", "row")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


def bucket_count(blocks: DataFrame, bytes_per_key: int) -> int:
    """Buckets for all keys of the corpus, from its size; as many as shuffle partitions at least."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(shuffle_partitions(blocks), total // bytes_per_key // BUCKET_KEYS + 1)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def packed(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The name of each key: its bucket and 32 of its bits."""
    return bucket_of(keys, n_buckets).astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def _summed(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(names by row, all names once, their sums of counts, the place of each name of each row in these)"""
    keys = [np.frombuffer(k.as_py(), np.uint32) for k in group["keys"]]
    counts = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in group["counts"]])
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, names, np.bincount(at, counts, len(names)).astype(np.uint32), at


def shared_keys(blocks: DataFrame, keys_of: Callable[[Block], np.ndarray], n_buckets: int, per_slice: int = SLICE_BLOCKS) -> DataFrame:
    """bucket, block, keys, counts: for each block the names of its keys that two or more documents have, and how many.

    ``keys_of`` gives the 64-bit keys of a block's documents, each once per document. A bucket is counted at once while there are no
    more than ``per_slice`` blocks; beyond that each slice of so many blocks is summed up first, then the sums of all slices, and each slice
    gets the bucket's shared names back. So a key that all blocks have takes no more room than others anywhere."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("words")
        for b in each_block(batches):
            names, counts = np.unique(packed(keys_of(b), n_buckets), return_counts=True)
            if not len(names):
                continue
            buckets = (names >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            low, counts = names.astype(np.uint32), counts.astype(np.uint32)
            parts = list(zip(np.split(low, cuts), np.split(counts, cuts)))
            columns = [buckets[np.concatenate([[0], cuts])], [b.block] * len(parts), [k.tobytes() for k, _ in parts], [c.tobytes() for _, c in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KEYS.types)], schema=_KEYS)

    def answers(group: pa.Table, keys: list[np.ndarray], sums: np.ndarray) -> pa.Table:
        out, a = [], 0
        for block, k in zip(group["block"].to_pylist(), keys):
            s = sums[a : a + len(k)]
            a += len(k)
            if (m := s > 1).any():
                out.append((block, k[m].tobytes(), s[m].tobytes()))
        columns = [[group["bucket"][0].as_py()] * len(out), *([x[i] for x in out] for i in range(3))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _KEYS.types)], schema=_KEYS)

    def meet(group: pa.Table) -> pa.Table:
        claim_worker("words")
        pa.default_memory_pool().release_unused()
        keys, _, sums, at = _summed(group)
        return answers(group, keys, sums[at])

    dealt = blocks.drop("digests").mapInArrow(deal, _KEYS_SQL)
    slices = blocks.count() // per_slice + 1
    if slices == 1:
        return dealt.groupBy("bucket").applyInArrow(meet, _KEYS_SQL)

    def total(shared_only: bool):
        def add(group: pa.Table) -> pa.Table:
            _, names, sums, _ = _summed(group)
            if shared_only:
                names, sums = names[sums > 1], sums[sums > 1]
            columns = [group["bucket"].slice(0, 1).combine_chunks(), pa.array([names.tobytes()]), pa.array([sums.tobytes()])]
            return pa.Table.from_arrays(columns, ["bucket", "keys", "counts"])

        return add

    def give_back(group: pa.Table, known: pa.Table) -> pa.Table:
        if not group.num_rows or not known.num_rows:
            return _KEYS.empty_table()
        keys = [np.frombuffer(k.as_py(), np.uint32) for k in group["keys"]]
        names, sums = (np.frombuffer(known[c][0].as_py(), np.uint32) for c in ("keys", "counts"))
        wanted = np.concatenate(keys)
        return answers(group, keys, look_up(names, sums, wanted))

    some = "bucket int, keys binary, counts binary"
    dealt = stored(dealt.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices))), "dealt-keys")
    sums = dealt.select("bucket", "slice", "keys", "counts").groupBy("bucket", "slice").applyInArrow(total(False), some).groupBy("bucket").applyInArrow(total(True), some)
    each = sums.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    return dealt.groupBy("bucket", "slice").cogroup(each.groupBy("bucket", "slice")).applyInArrow(give_back, _KEYS_SQL)


def unpack_shared(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names and counts from the rows that ``shared_keys`` has for one block."""
    if not group.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    names = np.concatenate([np.frombuffer(k.as_py(), np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, k in zip(group["bucket"].to_pylist(), group["keys"])])
    counts = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in group["counts"]])
    order = np.argsort(names)
    return names[order], counts[order]


def look_up(names: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The counts of ``wanted`` names, 1 for those that no other document has."""
    if not len(names):
        return np.ones(len(wanted), np.uint32)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, counts[at], np.uint32(1))
