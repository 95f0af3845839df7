"""BPE with word ends, encoded through a prefix-sharing trie (operator 12).

A word is a row of symbols, one per byte, of which the last carries the word's end. Merging by rank has a local description:
tokens are the encoding of their symbols exactly when every two neighbours are the encoding of theirs. So each prefix of a
word has one last token, the one that ends there and fits the last token of what precedes it, and that says
all about the prefix: going back from token to token gives its encoding.

The new words of an Arrow batch are put in order and inserted into one trie, whose nodes are numbered depth first. A node's state,
its last token, follows from the states above it; it is found once for all words that share the prefix. A word's
encoding is read off by going back from its leaf. Words that a worker has met are kept with their encodings, up to a bound.

Texts are put together from encoded words on Arrow buffers: one ``take`` of the words' strings gives the strings of all
texts of a batch, one after the other.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORKER_TABLES, claim_worker, table
from .fim import text_slices

#: Encoded words, and bytes of their strings, that a worker keeps from batch to batch.
KEPT_WORDS, KEPT_BYTES = 1 << 18, 32 << 20
#: Pairs of tokens of which a worker remembers whether they fit.
KEPT_PAIRS = 1 << 19
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 4 << 20

_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a tokenizer file of this kind: merges by rank over byte letters, with a suffix at word ends."""

    def __init__(self, data: bytes):
        self.data, spec = data, json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) or not model.get("end_of_word_suffix"):
            raise ValueError("not a BPE vocabulary with word ends and nothing else")
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a decoder or post-processor is not known here")
        normal = (spec.get("normalizer") or {}).get("normalizers") or []
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or normal[1]["pattern"] != {"Regex": r"\s+"} or [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["add_prefix_space"] or splits[1]["use_regex"]:
            raise ValueError("the normalizer or pre-tokenizer is not the one known here")
        self.pattern = splits[0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have to match as they are")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.shown = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = {c: b for b, c in enumerate(byte_letters())}
        of = lambda t: bytes(letters[c] for c in t)
        #: Bytes -> token, of those within a word and of those at its end.
        self.inner, self.final = {}, {}
        self.ends = {i: t.endswith(suffix) for t, i in vocab.items() if t not in self.special}
        self.length = {}
        for t, i in vocab.items():
            if t not in self.special:
                plain = of(t.removesuffix(suffix) if self.ends[i] else t)
                (self.final if self.ends[i] else self.inner)[plain] = i
                self.length[i] = len(plain)
        self.longest = max(self.length.values())
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank)
        for rank, merge in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[left, right] = rank
            token = vocab[self.shown[left] + self.shown[right]]
            if token in self.made or any(x in self.made and self.made[x][2] >= rank for x in (left, right)) or (self.length[left] + self.length[right] > 2 and any(self.length[x] > 1 and x not in self.made for x in (left, right))):
                raise ValueError("each token has to have one merge, after those of its parts")
            self.made[token] = (left, right, rank)
        if any(i not in self.made for i, n in self.length.items() if n > 1) or any(bytes((b,)) not in d for b in range(256) for d in (self.inner, self.final)):
            raise ValueError("each byte has to have a token within and at the end of words, and each longer token a merge")
        self.spines: dict[tuple[int, bool], list] = {}
        self.fit_memo: dict[int, bool] = {}

    def spine(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """(part, rank that makes it, rank that takes it up) of the parts at one edge of ``token``, from whole to byte."""
        if (known := self.spines.get((token, right))) is None:
            known, part, taken = [], token, _NEVER
            while part in self.made:
                rank = self.made[part][2]
                known.append((part, rank, taken))
                part, taken = self.made[part][1 if right else 0], rank
            known.append((part, -1, taken))
            self.spines[token, right] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Tokens ``a`` and ``b`` side by side stay two tokens when their symbols are merged by rank.

        They do unless parts that stand on either side of the cut at the same time merge before either is taken up by
        its own side; of equal ranks the one further left comes first."""
        rank = self.rank.get
        for x, x_made, x_taken in self.spine(a, True):
            for y, y_made, y_taken in self.spine(b, False):
                if x_made < y_taken and y_made < x_taken and (r := rank((x, y))) is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    def fit(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self.fit_memo.get(key)) is None:
            if len(self.fit_memo) >= KEPT_PAIRS:
                self.fit_memo.clear()
            known = self.fit_memo[key] = self.fits(a, b)
        return known


class Endings:
    """Which tokens end at a place of a word: an automaton over the bytes read, made as it is needed.

    Its state is the longest end of what has been read that begins a token; all tokens that end there are ends of it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.begins = {t[:i] for d in (vocabulary.inner, vocabulary.final) for t in d for i in range(len(t) + 1)}
        self.number = {b"": 0}
        self.read = [b""]
        #: state << 9 | end of the word << 8 | byte -> (state, [(token, its bytes), longest first])
        self.steps: dict[int, tuple[int, list[tuple[int, int]]]] = {}

    def step(self, key: int) -> tuple[int, list[tuple[int, int]]]:
        text = self.read[key >> 9] + bytes((key & 255,))
        table = self.v.final if key & 256 else self.v.inner
        ending = [(table[x], len(x)) for i in range(len(text)) if (x := text[i:]) in table]
        while text not in self.begins:
            text = text[1:]
        if (state := self.number.get(text)) is None:
            state = self.number[text] = len(self.read)
            self.read.append(text)
        if len(self.steps) >= KEPT_PAIRS:
            self.steps.clear()
        found = self.steps[key] = state, ending
        return found


class Trie:
    """Words as paths from the root; each node has its prefix's last token and the automaton's state.

    Words come in order, so nodes are made depth first: what lies above a node is known when it is made, and a prefix that
    the next words share is not looked at again."""

    def __init__(self, vocabulary: Vocabulary, endings: Endings | None = None):
        self.v, self.endings = vocabulary, endings or Endings(vocabulary)
        self.last, self.state = array("q", [-1]), array("q", [0])

    def insert(self, words: list[bytes]) -> Iterator[list[int]]:
        """The encodings of words, which are in order and not empty."""
        last, state, steps, step, length = self.last, self.state, self.endings.steps, self.endings.step, self.v.length
        memo, fit = self.v.fit_memo, self.v.fit
        path, before = [0], b""  # path[d]: the node of the first d bytes of the word before
        for word in words:
            shared, most = 0, min(len(before), len(word)) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            size = len(word)
            for depth in range(shared + 1, size + 1):
                key = state[path[-1]] << 9 | word[depth - 1] | (256 if depth == size else 0)
                after, ending = steps.get(key) or step(key)
                for token, n in ending:
                    left = last[path[depth - n]]
                    if left < 0:
                        break
                    if (fits := memo.get(left << 20 | token)) is None:
                        fits = fit(left, token)
                    if fits:
                        break
                else:
                    raise ValueError("no token fits")
                path.append(len(last))
                last.append(token)
                state.append(after)
            out, at = [], size
            while at:
                out.append(token := last[path[at]])
                at -= length[token]
            out.reverse()
            yield out
            del path[-1]  # a word's end is nobody's prefix
            before = word


class Words(dict):
    """Word -> number, given when first asked for; ``new`` are those without an encoding yet."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.new, self.endings = vocabulary, [], Endings(vocabulary)
        self.decimal = {i: f"{i} ".encode() for i in vocabulary.shown}
        self.spelled = {i: f"{t} ".encode() for i, t in vocabulary.shown.items()}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.counts, self.ids, self.shown = np.zeros(0, np.int64), pa.array([], pa.large_binary()), pa.array([], pa.large_binary())
        for text, token in self.v.special.items():
            self[text] = len(self)
            self._add([[token]])

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def _add(self, encoded: list[list[int]]) -> None:
        """Encodings of the next words: tokens in decimal and as they are shown, each followed by a blank."""
        self.counts = np.concatenate([self.counts, np.fromiter(map(len, encoded), np.int64, len(encoded))])
        joined = lambda names: pa.array([b"".join([names[t] for t in e]) for e in encoded], pa.large_binary())
        self.ids = pa.concat_arrays([self.ids, joined(self.decimal)])
        self.shown = pa.concat_arrays([self.shown, joined(self.spelled)])

    def encode_new(self) -> None:
        """One trie of all new words."""
        raw = [w.encode() for w in self.new]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        trie, encoded = Trie(self.v, self.endings), [None] * len(raw)
        for i, tokens in zip(order, trie.insert([raw[i] for i in order])):
            encoded[i] = tokens
        self._add(encoded)
        self.new = []


def lowered(text: str) -> str:
    """Small letters, letter by letter: a capital sigma at a word's end is no special case."""
    return text.replace("Σ", "σ").lower()


#: Characters that every version of Unicode of interest has; a text with others is searched for ``_unknown`` ones.
_COMMON = re.compile("[^\0-\u024f\u2000-\u2064]")


@functools.cache
def _unknown() -> re.Pattern:
    """Characters that Python's Unicode data lack. Libraries whose data are newer may know them."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class Splitter:
    """Text -> words: added tokens stay whole; the rest is composed (NFC), lowered and cut by the pattern."""

    def __init__(self, vocabulary: Vocabulary):
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.marks = tuple({t[:2] for t in vocabulary.special})
        self.any = regex.compile(vocabulary.pattern)
        # for texts without other characters than ASCII the same classes in a smaller alphabet
        self.ascii = re.compile(vocabulary.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.data, self.library = vocabulary.data, None
        self.letters = {c: b for b, c in enumerate(byte_letters())}

    def part(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if _COMMON.search(text) and _unknown().search(text):
            return self.by_library(text)
        return self.any.findall(lowered(unicodedata.normalize("NFC", text)))

    def by_library(self, text: str) -> list[str]:
        """Words of a text with characters that only the library's own Unicode data can class, by its normalizer and pre-tokenizer."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_buffer(self.data)
        letters = self.letters
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(letters[c] for c in w).decode() for w, _ in words]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not any(m in text for m in self.marks):
            return self.part(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.part(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.part(text[at:])


#: One set of words per worker and vocabulary.
_words: dict[bytes, tuple[Words, Splitter]] = {}
WORKER_TABLES["word_bpe"] = _words


def _known(data: bytes) -> tuple[Words, Splitter]:
    key = hashlib.sha256(data).digest()
    if key not in _words:
        v = Vocabulary(data)
        _words[key] = Words(v), Splitter(v)
    return _words[key]


def _texts(words: Words, split: Splitter, texts: list[str]) -> tuple[np.ndarray, list[memoryview], list[memoryview]]:
    """(tokens of each text, their decimal ids, the tokens as shown), blanks between."""
    flat, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        found = split(text)
        sizes[i + 1] = len(found)
        flat += found
    numbers = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
    del flat
    if words.new:
        words.encode_new()
    ends = np.cumsum(sizes)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(words.counts[numbers])])
    numbers = pa.array(numbers)

    def cut(strings: pa.Array) -> list[memoryview]:
        taken = strings.take(numbers)
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(taken) + 1] if offsets is not None else np.zeros(1, np.int64)
        data, at = memoryview(data) if data is not None else memoryview(b""), offsets[ends].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:])]

    return np.diff(sums[ends]), cut(words.ids), cut(words.shown)


def tokenize(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, kept_words: int = KEPT_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids (array of int) and decoded.

    ``vocabulary`` is the content of a tokenizer file, of fixed size whatever the data; it is broadcast. Decoding joins the tokens as they
    are shown with blanks, as the library does where a file names no decoder. Null texts are empty and have no tokens; null ids
    and repeated rows pass through; an empty table gives no rows; other columns are not read. A worker keeps ``kept_words`` words
    and those of one slice of ``slice_bytes`` of text (or of one text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = {"id": (pa.int64(), "long"), "n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}
    if with_ids:
        kinds |= {"ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string")}
    schema = pa.schema([(c, k) for c, (k, _) in kinds.items()])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("word_bpe")
        words, split = _known(shared.value)
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                if len(words) > kept_words or words.ids.nbytes + words.shown.nbytes > KEPT_BYTES:
                    words.forget()
                n, ids, shown = _texts(words, split, part["text"].to_pylist())
                sha = lambda rows: pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string())
                made = [part["id"], pa.array(n), sha(ids), sha(shown)]
                if with_ids:
                    made += [pa.array([list(map(int, bytes(r).split())) for r in ids], schema.field("ids").type), pa.array([bytes(r).decode() for r in shown], pa.string())]
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, ", ".join(f"{c} {s}" for c, (_, s) in kinds.items())).withColumnRenamed("id", id_col)


def public_vocabulary(name: str = "word_bpe_49k.json") -> bytes:
    """The content of a public tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), public_vocabulary(), with_ids=False)
