"""Removal of repeated byte strings by suffix arrays (operator 8).

A byte goes if it lies in a string of ``length`` bytes (a window) that also begins in a document with a
smaller id. Sorting all suffixes of the corpus in one place does not scale, so suffixes are sorted where
they can matter:

1. Each window picks an anchor: the 24-byte string in it with the least hash; its key is the anchor with the 13 bytes on
   its left, or where the window does not reach so far, on its right. Equal windows have equal keys, so only windows
   whose key other documents have, too (``shared_keys``), play a part.
2. Windows in a row that play a part are a piece of text. Pieces are cut at one in ``COARSE`` keys and
   dealt out by the key at which they begin, so that passages and near copies meet in long pieces.
   After a change in a text a piece begins elsewhere; so what is left of pieces meets once more by the key that follows them.
3. The suffixes of pieces that meet are sorted by linear grouping (``suffixes``), read as strings of ``SYMBOL`` bytes a symbol,
   counted from the place of the key. Suffixes next to each other that agree in so many symbols as hold a window at each
   of their first bytes are equal; the least id owns their windows, and all others lose them.
4. What is left after that, at the edges of passages and after changes within a piece, is dealt out once more by each window's
   own key, which equal windows always share, and sorted in the same way byte by byte, with the key as one symbol; so nothing is missed.
5. What was lost goes back to the blocks, which cut it out of their texts.

Pieces are dealt out by ranges of key and id, and a hot key's pieces lie in any number of tasks. An array takes
``heavy`` of them at most, and what it leaves meets again in the next round. Pieces without a window whose hash a piece of
another document has are not sorted. Pieces of one key that after the rounds still
have not all met (each adds windows of its own to a hot passage's edge) are split by window: these are grouped by
Spark, with partial aggregation. Whole texts that are equal are told by a digest of 128 bits and take no part in 2 to 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import Block, block_table, bucket_count, later_copies, look_up, packed, shared_keys, unpack_shared
from ._common import claim_worker, forget, shuffle_partitions, stored, table
from .suffixes import least_owners

LENGTH, ANCHOR = 50, 24
#: Pieces that one suffix array takes.
HEAVY = 256
#: Rounds in which the pieces of a hot key meet.
ROUNDS = 3
#: One in so many keys, by hash, begins a piece.
COARSE = 32
#: Bytes that long pieces are read by.
SYMBOL = 8
#: Symbols that one suffix array takes (or a single key's pieces), and the most windows of a piece.
SORT_SYMBOLS, MOST_WINDOWS = 16 << 10, 16 << 10
#: Pieces that a task sorts, roughly, and that it looks at together.
TASK_PIECES, TOGETHER = 20_000, 10_000
#: Window starts whose hashes are in memory at once.
CHUNK = 1 << 17

_U = np.uint64


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each string of k bytes: polynomials of doubled lengths put together, then scrambled."""
    base, by_length = 0x100000001B3, {1: data.astype(np.uint64) + _U(1)}

    def joined(a: np.ndarray, la: int, b: np.ndarray, lb: int) -> np.ndarray:
        n = max(0, min(len(a), len(b) - la))
        return a[:n] * _U(pow(base, lb, 1 << 64)) + b[la : la + n]

    whole, have, power = None, 0, 1
    while True:
        part = by_length[power]
        if k & power:
            whole = part if whole is None else joined(part, power, whole, have)
            have += power
        if have == k:
            return _scrambled(whole)
        by_length[power * 2] = joined(part, power, part, power)
        power *= 2


def anchors(block, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, its position, first window, last window) of the windows in a row that have one key, by position."""
    data, span, side = np.frombuffer(block.data, np.uint8), length - k + 1, (length - k + 1) // 2
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    doc = np.repeat(np.arange(len(block.lens), dtype=np.int32), block.lens)
    for c in range(0, max(0, len(data) - length + 1), CHUNK):
        h = _gram_hashes(data[c : c + CHUNK + length - 1], k)
        least = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & _U(0xFFFFFFFF)).astype(np.int64)
        window = np.arange(c, c + len(at))
        inside = doc[window] == doc[window + length - 1]
        at, window = at[inside], window[inside]
        if not len(at):
            continue
        new = np.concatenate([[True], at[1:] != at[:-1]])
        ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
        at = at[new]
        # those of a side that no window of the anchor reaches are not used
        left, right = h[np.maximum(at - side, 0)], h[np.minimum(at + side, len(h) - 1)]
        for x, y in zip(out, (at + c, window[new], window[ends], _scrambled(h[at] + left * _U(3)), _scrambled(h[at] + right * _U(5)))):
            x.append(y)
    if not out[0]:
        none = np.zeros(0, np.int64)
        return none.view(_U), none, none, none
    at, first, last, left, right = map(np.concatenate, out)
    cut = np.concatenate([[False], at[1:] == at[:-1]])  # one anchor, met in two chunks
    before = np.flatnonzero(cut) - 1
    last[before], right[before] = last[cut], right[cut]
    at, first, last, left, right = (x[~cut] for x in (at, first, last, left, right))
    key = np.stack([left, right], axis=1)
    first, last = np.stack([first, np.maximum(first, at - side + 1)], axis=1), np.stack([np.minimum(last, at - side), last], axis=1)
    at = np.stack([at - side, at], axis=1)
    some = first <= last
    return key[some], at[some], first[some], last[some]


def _anchor_keys(length: int, k: int):
    def keys(block: Block) -> np.ndarray:
        h, _, first, _ = anchors(block, length, k)
        doc = np.searchsorted(block.ends, first, side="right")
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        # rows that repeat an id are one document's: they have no smaller id than each other
        return h[np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])] if len(h) else h

    return keys


#: A piece has ``n`` windows from ``start`` on. Its bytes begin ``pre`` bytes before that, and its symbols ``at`` bytes after its first byte;
#: ``at2`` bytes, where pieces meet by ``key2``. In short pieces ``at2`` is the place of the key itself, or below 0 if it has several.
_PIECE = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("pre", pa.int32()), ("at", pa.int32()), ("piece", pa.binary()), ("key2", pa.int64()), ("at2", pa.int32())])
_PIECE_SQL = "key long, doc long, block long, start int, n int, pre int, at int, piece binary, key2 long, at2 int"
#: What became of a piece: lost to a smaller id; left, and all of its key have met; left, and not all have.
LOST, MET, OPEN = 0, 1, 2
_STATE = _PIECE.append(pa.field("state", pa.int32()))
_STATE_SQL = f"{_PIECE_SQL}, state int"
_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_OUT_SQL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(key, doc, block, start, n, place, low, high, data: bytes, shift, length: int, symbol: int, key2=None, place2=None) -> pa.Table:
    """Pieces as rows; one of too many windows is cut. ``start`` and the keys' places are within the block, which ``data`` begins
    ``shift`` bytes after; a piece's bytes reach over its windows by a symbol or two, within the text from ``low`` to ``high``."""
    times = (n + MOST_WINDOWS - 1) // MOST_WINDOWS
    part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    key2, place2 = (np.zeros(len(n), np.int64) if x is None else x for x in (key2, place2))
    key, doc, start, n, place, block, low, high, shift, key2, place2 = (np.repeat(x, times) for x in (key, doc, start, n, place, block, low, high, shift, key2, place2))
    start, n = start + part * MOST_WINDOWS, np.minimum(n - part * MOST_WINDOWS, MOST_WINDOWS)
    first, end = np.maximum(start - (symbol - 1), low), np.minimum(start + n + length - 1 + 2 * (symbol - 1), high)
    texts = [data[a:z] for a, z in zip((first - shift).tolist(), (end - shift).tolist())]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((key.view(np.int64), doc, block, start, n, start - first, (place - first) % symbol, texts, key2.view(np.int64), place2 - first), _PIECE.types)], schema=_PIECE)


def _runs_left(n: int, lost: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in lost:
        if a > at:
            out.append((at, a))
        at = b
    return out + [(at, n)] * (at < n)


def _settle(length: int, heavy: int, symbol: int, core: int = 0, last: bool = False):
    """Rows of pieces, sorted by key, with suffix arrays over those that meet -> the same with states, cut where they differ.

    ``last``: what is left of keys that have all met is not asked for any more. ``core``: the bytes of a key. Pieces of a key that all have it once are read with these bytes as one symbol."""
    # so many symbols hold a window at each byte of the first one
    whole = -(-(length + symbol - 1) // symbol)

    def symbols(texts: list[bytes], at: np.ndarray, named: bool, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts in a row, their numbers by text); ``of``: the numbers of their keys"""
        lens = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if named:
            stay = np.ones(len(data), bool)
            begin = np.cumsum(lens) - lens + at
            stay[(begin[:, None] + np.arange(1, core)).ravel()] = False
            out = data.astype(np.uint32)
            out[begin] = 256 + of
            return out[stay], lens - (core - 1)
        if symbol == 1:
            return data, lens
        sizes = np.maximum(lens - at, 0) // symbol
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begin = np.repeat(np.cumsum(lens) - lens + at, sizes) + symbol * inner
        out = np.zeros(len(begin), np.uint64)
        for i in range(symbol):
            out = out << _U(8) | data[begin + i]
        return out, sizes

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker()
        apart = True  # the first key of a task may have begun in another one
        held: pa.Table | None = None

        def looked_at(t: pa.Table, starts: np.ndarray, state: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``starts``: of the keys' rows; those of a key with too many meet in parts."""
            if last:
                sizes = np.diff(np.append(starts, t.num_rows))
                some = (sizes > 1) | (state == OPEN)
                if not some.any():
                    return
                t, state, sizes = t.filter(pa.array(np.repeat(some, sizes))), state[some], sizes[some]
                starts = np.cumsum(sizes) - sizes
            if core:
                once = np.minimum.reduceat(t["at2"].to_numpy(), starts) >= 0
                rows = np.repeat(once, np.diff(np.append(starts, t.num_rows)))
                for named in (True, False):
                    if (once == named).any():
                        some = t.filter(pa.array(rows == named))
                        key = some["key"].to_numpy()
                        yield from met(some, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), state[once == named], named)
            else:
                yield from met(t, starts, state, False)

        def met(t: pa.Table, starts: np.ndarray, state: np.ndarray, named: bool) -> Iterator[pa.RecordBatch]:
            width = length - core + 1 if named else whole
            cover = 1 if named else symbol * width - length + 1
            sizes = np.diff(np.append(starts, t.num_rows))
            within, key_of = np.arange(t.num_rows) - np.repeat(starts, sizes), np.repeat(np.arange(len(starts)), sizes)
            state = np.where(np.repeat(sizes, sizes) > heavy, OPEN, np.repeat(state, sizes)).astype(np.int32)
            unit = np.cumsum((within % heavy == 0) | (within == 0)) - 1
            texts, docs, at = t["piece"].to_pylist(), t["doc"].to_numpy(), t["at"].to_numpy().astype(np.int64)
            string, sizes = symbols(texts, t["at2"].to_numpy().astype(np.int64) if named else at, named, key_of)
            begin = np.cumsum(sizes) - sizes
            # windows whose hash another document has in the same unit
            count = np.maximum(sizes - width + 1, 0)
            piece = np.repeat(np.arange(len(texts)), count)
            place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + begin[piece]
            sort = np.zeros(len(texts), bool)
            if len(piece):
                h = _gram_hashes(string, width)[place] ^ _scrambled(unit[piece].astype(np.uint64) + _U(1))
                order = np.argsort(h)
                h, piece = h[order], piece[order]
                runs = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                several = np.minimum.reduceat(docs[piece], runs) < np.maximum.reduceat(docs[piece], runs)
                sort[piece[np.repeat(several, np.diff(np.append(runs, len(h))))]] = True
            rest = ~sort & (state == OPEN) if last else ~sort
            if rest.any():
                kept = t.filter(pa.array(rest)).append_column("state", pa.array(state[rest], pa.int32()))
                yield from kept.to_batches()
            out: list[tuple] = []
            picked = np.flatnonzero(sort)
            keys, blocks, start, n, pre, keys2, at2 = (t[c].to_numpy() for c in ("key", "block", "start", "n", "pre", "key2", "at2"))
            total, a = np.cumsum(sizes[picked]), 0
            while a < len(picked):
                # whole units, as many as an array takes
                z = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + SORT_SYMBOLS)), a + 1)
                while z < len(picked) and unit[picked[z]] == unit[picked[z - 1]]:
                    z += 1
                some = picked[a:z].tolist()
                lost = least_owners([string[begin[i] : begin[i] + sizes[i]] for i in some], docs[some].tolist(), width)
                for i, runs in zip(some, lost):
                    shift, m = int(at[i] - pre[i]), int(n[i])
                    gone = [(max(shift + symbol * x, 0), min(shift + symbol * (y - 1) + cover, m)) for x, y in runs]
                    gone = [(x, y) for x, y in gone if x < y]
                    row = (int(keys[i]), int(docs[i]), int(blocks[i]))
                    extra = len(texts[i]) - m
                    out.extend((*row, int(start[i]) + x, y - x, 0, 0, None, 0, 0, LOST) for x, y in gone)
                    if last and state[i] == MET:
                        continue
                    out.extend((*row, int(start[i]) + x, y - x, int(pre[i]), int(at[i] - x) % symbol, texts[i][x : y + extra], int(keys2[i]), int(at2[i] - x), int(state[i])) for x, y in _runs_left(m, gone))
                a = z
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), _STATE.types)], schema=_STATE)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < TOGETHER:
                continue
            key = held["key"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            if len(starts) == 1:  # a hot key
                yield from looked_at(held, starts, np.array([OPEN]))
                apart, held = True, None
                continue
            state = np.full(len(starts) - 1, MET)
            state[0] = OPEN if apart else MET
            yield from looked_at(held.slice(0, int(starts[-1])), starts[:-1], state)
            apart, held = False, held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            key = held["key"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            state = np.full(len(starts), MET)
            state[-1] = OPEN
            state[0] = OPEN if apart else state[0]
            yield from looked_at(held, starts, state)

    return settle


def _met(pieces: DataFrame, length: int, heavy: int, symbol: int, rounds: int, tag: str, core: int = 0, last: bool = False) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(tables with lost windows, tables of all pieces with states in turn, pieces left of keys that have not all met)."""
    lost, tables, now = [], [], pieces
    for _ in range(rounds):
        parts = max(1, min(now.count() // TASK_PIECES + 1, 100 * shuffle_partitions(now)))
        dealt = now.select(*_PIECE.names).repartitionByRange(parts, "key", "doc", "block", "start").sortWithinPartitions("key", "doc")
        done = stored(dealt.mapInArrow(_settle(length, heavy, symbol, core, last), _STATE_SQL), tag)
        tables.append(done)
        lost.append(stored(done.filter(F.col("state") == LOST).select("block", "start", "n"), "repeats-lost"))
        now = done.filter(F.col("state") == OPEN).drop("state")
        if now.groupBy("key").count().filter(F.col("count") > 1).isEmpty():
            break
    return lost, tables, now


def _left(tables: list[DataFrame], open_: DataFrame) -> DataFrame:
    """All pieces that the rounds have left."""
    for t in tables:
        open_ = open_.unionByName(t.filter(F.col("state") == MET).drop("state"))
    return open_


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, with_text: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes).

    Null texts are empty. A null id counts as larger than all ids and equal to other null ids; rows that repeat
    an id never cover each other. Repeats within one document stay. An empty table gives no rows; other columns are not read."""
    blocks = block_table(docs, id_col, text_col, "repeats-blocks")
    n_buckets = bucket_count(blocks, max(1, (length - k + 2) // 3))
    # stored, so that the exchange of all keys is gone before pieces are made
    shared = stored(shared_keys(blocks, _anchor_keys(length, k), n_buckets), "repeats-shared")
    copies = stored(later_copies(blocks), "repeats-copies")

    def first_pieces(text: pa.Table, keys: pa.Table) -> pa.Table:
        if not text.num_rows or not keys.num_rows:
            return _PIECE.empty_table()
        b = Block(text.to_pylist()[0])
        copy = np.zeros(len(b.ids), bool)
        whole = keys["row"].is_valid()
        copy[keys.filter(whole)["row"].to_numpy()] = True
        h, at, first, last = anchors(b, length, k)
        row = np.searchsorted(b.ends, first, side="right")
        m = look_up(*unpack_shared(keys.filter(pc.invert(whole))), packed(h, n_buckets)) > 1
        m &= ~copy[row]
        if not m.any():
            return _PIECE.empty_table()
        h, at, first, last, row = h[m], at[m], first[m], last[m], row[m]
        run = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)])
        coarse = (h >> _U(7)) % _U(COARSE) == 0
        # texts that repeat one key over and over are not cut there
        new = run | coarse & np.concatenate([[True], h[1:] != h[:-1]])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(h)) - 1
        # before a run's first coarse key stands a piece that is known by that; a run without one is known by its least key
        follows = np.append(~run[starts[1:]], False)
        least = np.minimum.reduceat(h, starts)
        where = np.flatnonzero(h == np.repeat(least, ends - starts + 1))
        of, first_of = np.unique(np.searchsorted(starts, where, side="right") - 1, return_index=True)
        best = where[first_of]  # by piece, as each has a least key
        head = ~coarse[starts]
        after = np.append(starts[1:], 0)
        named_by = np.where(head, np.where(follows, after, best), starts)
        key = np.where(head & follows, ~h[named_by], h[named_by])
        text = row[starts]
        # the coarse key that follows, where there is one: after a change in a text, that is what pieces have in common
        key2 = np.where(follows, ~h[after], _U(0))
        return _cut(key, b.ids[text], np.full(len(starts), b.block), first[starts], last[ends] - first[starts] + 1, at[named_by], b.starts[text], b.ends[text], b.data, np.zeros(len(starts), np.int64), length, SYMBOL, key2, at[after])

    names = ["bucket", "block", "keys", "counts", "row"]
    known = shared.withColumn("row", F.lit(None).cast("int")).unionByName(copies.select(F.lit(None).cast("int").alias("bucket"), "block", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), "row")).select(*names)
    pieces = stored(blocks.drop("digests").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(first_pieces, _PIECE_SQL), "repeats-pieces")
    forget(shared)
    lost, first_tables, open_ = _met(pieces, length, heavy, SYMBOL, rounds, "repeats-long")
    forget(pieces)
    left = _left(first_tables, open_)
    again = left.filter("key2 != 0").withColumns({"key": F.col("key2"), "at": F.pmod("at2", F.lit(SYMBOL)).cast("int")})
    more, second_tables, open_ = _met(again, length, heavy, SYMBOL, 1, "repeats-long")
    left = _left(second_tables, open_).unionByName(left.filter("key2 = 0"))

    def by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker()
        for batch in batches:
            n, start = batch["n"].to_numpy(), batch["start"].to_numpy().astype(np.int64)
            texts = [x[p : p + m + length - 1] for x, p, m in zip(batch["piece"].to_pylist(), batch["pre"].to_pylist(), n.tolist())]
            b = SimpleNamespace(data=b"".join(texts), lens=np.array([len(t) for t in texts], np.int64))
            h, at, first, last = anchors(b, length, k)
            if not len(h):
                continue
            ends = np.cumsum(b.lens)
            shift = ends - b.lens - start  # from places in the block to those in the texts put together
            row = np.searchsorted(ends, first, side="right")
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
            several = np.diff(np.append(new, len(h))) > 1
            last, row, first, at = last[np.append(new[1:], len(h)) - 1], row[new], first[new], at[new]
            back = -shift[row]
            # where a text repeats one key over and over, the piece is one that has it several times
            at = np.where(several, -MOST_WINDOWS * MOST_WINDOWS, at + back)
            yield from _cut(h[new], batch["doc"].to_numpy()[row], batch["block"].to_numpy()[row], first + back, last - first + 1, at, start[row], start[row] + b.lens[row], b.data, back, length, 1, place2=at).to_batches()

    near = stored(left.mapInArrow(by_anchor, _PIECE_SQL), "repeats-near")
    forget(*first_tables, *second_tables)
    most, near_tables, open_ = _met(near, length, heavy, 1, rounds, "repeats-short", k + (length - k + 1) // 2, last=True)
    forget(near)

    windows = open_.select("key", "doc", "block", "start", "piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("from_"))
    windows = windows.select("key", "doc", "block", (F.col("start") + F.col("from_")).alias("start"), F.substring("piece", F.col("from_") + 1, F.lit(length)).alias("window"))
    least = windows.groupBy("key", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    split = stored(windows.join(least, ["key", "window"]).filter("doc > least").select("block", "start", F.lit(1).alias("n")), "repeats-lost")
    forget(*near_tables)
    lost += [*more, *most, split]

    gone = copies.select("block", F.col("row").alias("a"), F.lit(-1).alias("b"))
    for x in lost:
        gone = gone.unionByName(x.select("block", F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).alias("b")))

    def cut_out(text: pa.Table, gone: pa.Table) -> pa.Table:
        if not text.num_rows:
            return _OUT.empty_table()
        b = Block(text.to_pylist()[0])
        step = np.zeros(len(b.data) + 1, np.int32)
        a, z = gone["a"].to_numpy(), gone["b"].to_numpy()
        whole = a[z < 0]
        whole = whole[b.lens[whole] >= length]
        np.add.at(step, np.append(a[z >= 0], b.starts[whole]), 1)
        np.add.at(step, np.append(z[z >= 0], b.ends[whole]), -1)
        keep = np.cumsum(step[:-1]) == 0
        data, rows = np.frombuffer(b.data, np.uint8), []
        for i, s, e in zip(b.real_ids(), b.starts.tolist(), b.ends.tolist()):
            k_ = keep[s:e]
            rest = data[s:e][k_].tobytes()
            spans = int((~k_[:1]).sum() + (k_[:-1] & ~k_[1:]).sum())
            rows.append((i, e - s, e - s - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_OUT.types)], schema=_OUT)

    out = blocks.drop("digests").groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(cut_out, _OUT_SQL)
    out = stored(out.withColumnRenamed("id", id_col), "repeats-result")
    forget(blocks, copies, *lost)
    return out


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


#: The rule itself: every window of 50 bytes, its least owner, and what that leaves.
OP8_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b)::BIGINT AS n_bytes FROM d),
p AS (SELECT doc_id, b, unnest(range(1, n_bytes - 48)) AS i FROM n),
w AS (SELECT doc_id, i, b[i : i + 49] AS win FROM p),
o AS (SELECT win, min(doc_id) AS owner FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
l AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN o ON o.win = w.win WHERE w.doc_id > owner),
s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l),
r AS (SELECT doc_id, run, min(i) AS first, max(i) + 49 AS last FROM s GROUP BY doc_id, run),
g AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(last - first + 1)::BIGINT AS n_removed FROM r GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) + 1 AS a, first - 1 AS z FROM r
      UNION ALL SELECT r.doc_id, max(last) + 1, max(n_bytes) FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id),
h AS (SELECT k.doc_id, string_agg(CASE WHEN a <= z THEN hex(b[a : z]) ELSE '' END, '' ORDER BY a) AS rest FROM k JOIN n ON n.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN h.rest IS NULL THEN b ELSE unhex(h.rest) END) AS kept_sha256
FROM n LEFT JOIN g ON g.doc_id = n.doc_id LEFT JOIN h ON h.doc_id = n.doc_id
"""
