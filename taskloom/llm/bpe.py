"""Byte-level BPE by a lazily determinised transducer (operator 6).

Merging by rank has a local description: a sequence of tokens is the encoding of its bytes exactly when
every two neighbours are the encoding of theirs. So each prefix of a piece has one last token, the one that ends
there and fits the last token of what precedes it. Reading byte by byte, it is unknown which of the recent
positions the final encoding runs through; as soon as all positions where a longer token may still begin
have the same ancestor, the tokens up to it are certain and are emitted.

A state is therefore the last emitted token and the bytes after it. States and transitions are made when
first needed and kept in a table of bounded size. How far emission lags behind is bounded by the longest token.

Decoding maps ids to bytes as they come and hands out text up to the last whole character, which a
state machine over the UTF-8 byte classes finds; the rest waits for the next ids.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORKER_TABLES, claim_worker, leave_worker, table

#: States, and encoded pieces, that a worker keeps, where other operators need memory, too.
KEPT = 1 << 17
#: Tokens that the decoder takes at a time.
DECODE_TOKENS = 1 << 14


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token -> rank from the lines of a rank file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class _State:
    """``key``: the last emitted token, then, for all positions where a later token may begin, the bytes since and the
    tokens up to it; the last position is the end. It is flat and its bytes are those of the tables, so that many fit in memory."""

    __slots__ = ("key", "next")

    def __init__(self, key: tuple):
        self.key, self.next = key, None


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = KEPT):
        self.ranks, self.limit = ranks, states
        self.begins = {b: b for b in {t[:i] for t in ranks for i in range(len(t))}}
        self.tokens = {t: t for t in ranks}
        self.byte = [bytes((i,)) for i in range(256)]
        self.fits_memo: dict[tuple[bytes, bytes], bool] = {}
        self.edges: dict[tuple[bytes, bool], list] = {}
        self.start = _State((b"", b"", ()))
        self.states: dict[tuple, _State] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a few bytes, by the definition: always the neighbours of least rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        """(part, its rank, rank of the merge that takes it up) of the parts that stand at one edge while ``token`` is merged."""
        if (known := self.edges.get((token, right))) is None:
            known = [(token, self.ranks[token], 1 << 60)]
            if len(token) > 1:
                parts = [token[i : i + 1] for i in range(len(token))]
                seen = [(parts[-1 if right else 0], self.ranks[parts[-1 if right else 0]])]
                taken = []
                while len(parts) > 1:
                    rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if rank == 1 << 60:
                        return []  # merging never arrives at this token
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                    if (x := parts[-1 if right else 0]) != seen[-1][0]:
                        taken.append(rank)
                        seen.append((x, rank))
                known = [(x, r, n) for (x, r), n in zip(seen, [*taken, 1 << 60])]
            self.edges[token, right] = known
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """``a`` and ``b`` side by side are the encoding of their bytes (``a`` may be nothing).

        They are unless, while both are merged, what stands at the right edge of ``a`` and at the left edge of ``b`` at the same
        time merges sooner than either is taken up by its own side; of equal ranks the left one comes first."""
        key = (a, b)
        if (known := self.fits_memo.get(key)) is None:
            if len(self.fits_memo) > 4 * self.limit:
                self.fits_memo.clear()
            left, right = self.edge(a, True) if a else [], self.edge(b, False)
            known = bool(right) and (bool(left) or not a)
            for x, from_x, to_x in left:
                for y, from_y, to_y in right:
                    if from_x < to_y and from_y < to_x and (r := self.ranks.get(x + y)) is not None and r < to_x and r <= to_y:
                        known = False
            self.fits_memo[key] = known
        return known

    def step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        ranks, begins, tokens, memo, one = self.ranks, self.begins, self.tokens, self.fits_memo, self.byte[byte]
        last, *places = state.key
        live, ended, walk = [], None, iter(places)
        for since, path in zip(walk, walk):
            since += one
            if ended is None and (token := tokens.get(since)) is not None:
                before = path[-1] if path else last
                if (fit := memo.get((before, token))) is None:
                    fit = self.fits(before, token)
                if fit:
                    ended = (*path, token)
            if (known := begins.get(since)) is not None:
                live += known, path
        if ended is None:
            raise ValueError("these ranks lack a byte")
        live += b"", ended
        first, emitted = live[1], ()
        if first:  # tokens that all live paths begin with are certain
            sure = len(first)
            for path in live[3::2]:
                while first[:sure] != path[:sure]:
                    sure -= 1
            if sure:
                last, emitted = first[sure - 1], tuple([ranks[t] for t in first[:sure]])
                live[1::2] = [path[sure:] for path in live[1::2]]
        # without a live path from here on, the last token plays no part any more
        key = (b"" if live[1] else last, *live)
        if (after := self.states.get(key)) is None:
            if len(self.states) >= self.limit:
                self.forget()
            after = self.states[key] = _State(key)
        if state.next is None:
            state.next = {}
        state.next[byte] = found = (after, emitted)
        return found

    def forget(self) -> None:
        """Drop all states; their links are cut, so that no cycles are left."""
        for s in self.states.values():
            s.next = None
        self.states.clear()
        self.start.next = None

    def encode(self, piece: bytes) -> list[int]:
        state, out, step = self.start, [], self.step
        for byte in piece:
            found = state.next.get(byte) if state.next else None
            state, emitted = found if found is not None else step(state, byte)
            if emitted:
                out += emitted
        out += [self.ranks[t] for t in state.key[-1]]
        return out


class PieceEncoder(dict):
    """Piece of text -> its ids in decimal, joined by spaces. When there are too many, those not used lately are forgotten."""

    def __init__(self, transducer: Transducer, limit: int = KEPT):
        super().__init__()
        self.transducer, self.limit, self.before = transducer, limit, {}

    def __missing__(self, piece: str) -> str:
        if (ids := self.before.get(piece)) is None:
            ids = " ".join(map(str, self.transducer.encode(piece.encode())))
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _utf8_classes() -> list[dict[int, int]]:
    """Transitions over bytes. 0: between characters; 1 to 3: so many plain continuation bytes to come;
    4 to 7: after E0, ED, F0, F4, whose next byte has a narrower range."""
    some = lambda a, b, to: dict.fromkeys(range(a, b + 1), to)
    lead = some(0, 0x7F, 0) | some(0xC2, 0xDF, 1) | some(0xE1, 0xEF, 2) | {0xE0: 4, 0xED: 5} | some(0xF1, 0xF3, 3) | {0xF0: 6, 0xF4: 7}
    return [lead, some(0x80, 0xBF, 0), some(0x80, 0xBF, 1), some(0x80, 0xBF, 2), some(0xA0, 0xBF, 1), some(0x80, 0x9F, 1), some(0x90, 0xBF, 2), some(0x80, 0x8F, 2)]


_UTF8 = _utf8_classes()


class StreamDecoder:
    """Text from byte chunks that may end within a character; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        # only the last three bytes can belong to a character that is not whole
        for back in range(1, min(3, cut) + 1):
            if data[-back] >= 0xC0:
                state = 0
                for byte in data[-back:]:
                    state = _UTF8[state].get(byte, -1)
                    if state < 0:
                        break
                if state > 0:
                    cut -= back
                break
            if data[-back] < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[str], tokens: dict[str, bytes], size: int = DECODE_TOKENS) -> Iterator[str]:
    ids, decoder = list(ids), StreamDecoder()
    for a in range(0, len(ids), size):
        yield decoder.feed(b"".join(map(tokens.__getitem__, ids[a : a + size])))
    yield decoder.close()


#: One encoder per worker and rank file.
_encoders: dict[tuple, tuple] = {}
WORKER_TABLES["bpe"] = _encoders


def _encoder(data: bytes, pattern: str, kept: int) -> tuple:
    key = (hashlib.sha256(data).digest(), pattern, kept)
    if key not in _encoders:
        ranks = read_ranks(data)
        _encoders[key] = PieceEncoder(Transducer(ranks, kept), kept), {str(r): t for t, r in ranks.items()}, regex.compile(pattern)
    return _encoders[key]


def tokenize(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, kept: int = KEPT, resting: bool = True) -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, ids_sha256, decoded_sha256, and ids (array of int).

    ``kept`` bounds the states, and the encoded pieces, that a worker keeps: more of them take more memory and less time. ``resting``: they keep them from task to task; else each task makes its own.
    ``ranks`` is the content of a rank file, of fixed size whatever the data; it is broadcast. Null texts are
    empty and have no tokens; null ids and repeated rows pass through; an empty table gives no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("bpe")
        encoder, tokens, split = _encoder(shared.value, pattern, kept)
        # the collector would walk all states and pieces again and again, and they leave no cycles behind
        gc.disable()
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part, rows = batch.slice(a, 256), []
                    for i, text in zip(part["id"].to_pylist(), part["text"]):
                        line = " ".join(map(encoder.__getitem__, split.findall(text.as_py())))
                        ids = line.split(" ") if line else []
                        decoded = hashlib.sha256()
                        for t in decode_stream(ids, tokens):
                            decoded.update(t.encode())
                        rows.append((i, len(ids), hashlib.sha256(line.encode()).hexdigest(), decoded.hexdigest(), list(map(int, ids)) if with_ids else None))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)
        finally:  # the worker goes on with other functions
            gc.enable()
            if not resting:
                encoder = tokens = None
                leave_worker()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>").withColumnRenamed("id", id_col)


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """A public rank file and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_ranks()
    return tokenize(table(spark, sf_dir, "documents"), ranks, pattern, with_ids=False, kept=2 * KEPT).drop("ids")
