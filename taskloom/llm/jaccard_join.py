"""Similarity join on word shingles, by a size-aware heavy-light join (operator 3).

Two documents link when 100 * |intersection| >= 75 * |union| of their sets of 5-word shingles.

1. Documents with equal sets are one node. Shingles that only one document has are known after one exchange
   of packed keys (``shared_keys``), with the document count of all others; that is the global order, rarest first.
2. Sets of linked documents share a shingle among the first n - ceil(0.75 n) + 1 of either in that order, and two among
   the first n - ceil(0.75 n) + 2. A set with only shingles of its own there has no links at all.
   * Light sets (few shingles) enumerate the subsets of two of the latter; only sets with an equal subset are compared.
   * Heavy sets scan the inverted lists of the former; light sets near enough in size are in these lists, too.
   Lists and subsets are kept apart by the sizes of both sides, in bands: from the place of the (last) shared shingle in a
   set's order follows how large a linked set can be at most, and a set only enters the lists of bands below that. Within
   a list, sets go that no other member can link to by these bounds.
   The boundary between the two is the size at which the measured costs, subsets made against list entries read,
   have the least sum.
3. A list or subset of many sets is not multiplied out. It is compared with one pivot; that gives exact links, and exact
   distances to the pivot. Jaccard distance is a metric, so links only join members whose distances differ by 0.25
   at most: the list falls into rings of that width, and only neighbouring rings stay together. A list whose members are
   in one component is done. So a group of near copies costs about as many comparisons as it has members,
   and no link between components is ever skipped. In lists still left after ``rounds`` pivots, members outside the
   largest component are compared with those of other components that the bounds on sizes allow, which settles the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import BLOCK_BYTES, Block, block_table, bucket_count, look_up, packed, shared_keys, unpack_shared
from ._common import LOWER, UPPER, WORKER_TABLES, claim_worker, forget, give_back, join_owners, stored, table
from ._graph import components
from .repeats import _scrambled

WORDS = 5
#: Similarity as a share of 100.
PERCENT = 75
#: Pivots per list before what is left of it is compared pair by pair.
ROUNDS = 3
#: Pairs up to which their nodes (16 bytes each) are broadcast.
MOST_BROADCAST = 200_000
#: The largest size of a band is this times its least, roughly.
BAND = 1.1
#: Sizes above this are never light: their subsets are too many at any cost of lists.
MOST_LIGHT = 64

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class _WordHashes(dict):
    """Word -> 64-bit hash, forgotten now and then."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _WordHashes()
WORKER_TABLES["words"] = _word_hash


def shingle_sets(texts: Iterator[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles. A text of fewer words has one, its whole sequence."""
    split = [t.translate(_LOWER).split() for t in texts]
    lens = np.array([len(s) for s in split], np.int64)
    h = np.fromiter((_word_hash[w] for s in split for w in s), np.uint64, int(lens.sum()))
    doc = np.repeat(np.arange(len(split)), lens)
    n = max(0, len(h) - words + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _FACTORS[k % 6] * np.uint64(2 * (k // 6) + 1)
    whole = doc[:n] == doc[words - 1 : words - 1 + n] if n else np.zeros(0, bool)
    grams, owner = _scrambled(grams[whole]), doc[:n][whole]
    cuts = np.searchsorted(owner, np.arange(len(split) + 1))
    ends = np.cumsum(lens)
    out = []
    for i, size in enumerate(lens.tolist()):
        if size >= words:
            out.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[ends[i] - size : ends[i]].tobytes(), size)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set linked to it, at least."""
    return -(-percent * n // 100)


_SETS = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("node", pa.binary()), ("items", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("n_basic", pa.int32())])
_SETS_SQL = "block long, doc long, n int, node binary, items array<long>, prefix array<long>, places array<int>, counts array<long>, n_basic int"


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, resting: bool = True) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id.

    A null or blank text has no shingles and links with nothing: its component is its own id. A null id never names a
    component that has another id. Rows that repeat an id are separate rows with one name. An empty table gives
    no rows; other columns are not read. ``block_bytes``: of text that a task in Python looks at together. ``resting``: what a worker has freed stays with it
    from block to block; else it goes back after each."""
    blocks = block_table(docs, id_col, text_col, "jaccard-blocks", block_bytes)
    n_buckets = bucket_count(blocks, 6)

    def keys_of(b: Block) -> np.ndarray:
        if not resting:
            give_back()
        distinct = {s.tobytes(): s for s in shingle_sets(b.texts(), words)}
        return np.concatenate(list(distinct.values())) if distinct else np.zeros(0, np.uint64)

    shared = shared_keys(blocks, keys_of, n_buckets)

    def describe(text: pa.Table, keys: pa.Table) -> pa.Table:
        if not text.num_rows:
            return _SETS.empty_table()
        b = Block(text.to_pylist()[0])
        claim_worker("words")
        names, counts = unpack_shared(keys)
        sets = shingle_sets(b.texts(), words)
        rows, seen = [], set()
        for doc, s in zip(b.real_ids(), sets):
            n = len(s)
            node = xxhash.xxh3_128_digest(s.tobytes()) if n else None
            rows.append((b.block, doc, n, node, None, None, None, None, None))
            if not n or node in seen:
                continue
            seen.add(node)
            df = look_up(names, counts, packed(s, n_buckets))
            basic = n - _least_overlap(n, percent) + 1
            if (df == 1).sum() > basic:
                continue  # all that could link it is its own
            order = np.lexsort((s, df))[: basic + 1]
            keep = df[order] > 1
            if keep.any():
                signed = s.view(np.int64)
                rows.append((b.block, None, n, node, signed, signed[order[keep]], np.flatnonzero(keep).astype(np.int32), df[order[keep]].astype(np.int64), int(keep[:basic].sum())))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SETS.types)], schema=_SETS)

    def describe_and_rest(text: pa.Table, keys: pa.Table) -> pa.Table:
        try:
            return describe(text, keys)
        finally:
            give_back()

    found = stored(blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(describe if resting else describe_and_rest, _SETS_SQL), "jaccard-sets")
    members = found.filter(F.col("items").isNull()).select("doc", "n", "node")
    some = found.filter(F.col("items").isNotNull())
    first = some.groupBy("node").agg(F.min("block").alias("block"))
    sets = stored(some.join(first, ["node", "block"]).select("node", "n", "items", "prefix", "places", "counts", "n_basic"), "jaccard-nodes")

    roots = _linked(sets, _probes(sets, _boundary(sets), percent), percent, rounds)
    # sets first, each with its rows counted and their least id; then components; then back to the rows
    nodes = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("rows"))
    nodes = stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-named")
    tops = nodes.groupBy("root").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("nodes"))
    named = join_owners(nodes, tops, ["root"], "nodes").select("node", "top", "rows")
    linked = join_owners(members.filter("node IS NOT NULL"), named, ["node"], "rows").select("doc", "n", "top")
    out = linked.unionByName(members.filter("node IS NULL").select("doc", "n", F.col("doc").alias("top")))
    out = stored(out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("top").alias("component_id")), "jaccard-result")
    forget(blocks, found, sets, nodes)
    return out


def _boundary(sets: DataFrame) -> int:
    """The size up to which sets are light: the one with the least measured cost of subsets and lists."""
    size = F.least("n", F.lit(MOST_LIGHT + 1))
    shared = F.size("prefix").cast("double")
    lists = F.aggregate(F.slice("counts", 1, F.col("n_basic")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = sets.groupBy(size.alias("size")).agg(F.sum(shared * (shared - 1) / 2).alias("subsets"), F.sum(lists).alias("lists")).collect()  # MOST_LIGHT + 1 rows at most
    subsets, lists_ = {r["size"]: r["subsets"] for r in rows}, {r["size"]: float(r["lists"]) for r in rows}

    def cost(b: int) -> float:
        return sum(v for k, v in subsets.items() if k <= b) + sum(v for k, v in lists_.items() if 100 * k > PERCENT * b)

    return min(range(2, MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _probes(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(key, node, n, most): the subsets of two of light sets, and the list entries of heavy sets and their light neighbours, by band.

    If the last of ``shared`` common shingles stands at ``place`` (from 0) in a set of n, and no other common one before it,
    the sets have n - place - 1 + shared in common at most. A linked set of m has percent / (100 + percent) * (n + m)
    of them at least, which bounds m: ``most``."""
    n, slack, reach = F.col("n").cast("double"), 1e-6, math.ceil(math.log(100 / percent) / math.log(BAND)) + 1
    band = F.floor(F.log(n) / math.log(BAND)).cast("int")

    def keys(hashed: Column, place: Column, shared: int) -> Column:
        most = (n - place - 1 + shared) * (100 + percent) / percent - n + slack
        low = lambda c: F.pow(F.lit(BAND), c)
        fits = lambda c: (low(c) <= most) & (low(c) <= n * 100 / percent + slack) & (low(c + 1) >= n * percent / 100 - slack)
        return F.transform(F.filter(F.sequence(band - reach, band + reach), fits), lambda c: F.struct(F.xxhash64(hashed, F.least(band, c), F.greatest(band, c)).alias("key"), F.floor(most).cast("int").alias("most")))

    light, heavy = F.col("n") <= boundary, 100 * F.col("n") > percent * boundary
    none = F.array().cast("array<array<struct<key:long,most:int>>>")
    entries = F.arrays_zip("prefix", "places")
    pairs = F.flatten(F.transform(entries, lambda x, i: F.transform(F.slice(entries, i + 2, F.size("prefix")), lambda y: keys(F.xxhash64(x["prefix"], y["prefix"]), y["places"], 2))))
    lists = F.transform(F.slice(entries, 1, F.col("n_basic")), lambda x: keys(F.xxhash64(x["prefix"], F.lit("list")), x["places"], 1))
    both = F.concat(F.when(light, pairs).otherwise(none), F.when(heavy, lists).otherwise(none))
    return sets.select("node", "n", F.explode(F.flatten(both)).alias("k")).select("k.key", "node", "n", "k.most")


def _linked(sets: DataFrame, probes: DataFrame, percent: int, rounds: int) -> DataFrame:
    """(node, root) of all nodes that link to another one."""
    items = sets.select("node", "n", "items")
    # far: the distance to the last pivot in thousandths. The next pivot is one that it does not link to, if there is any, and of
    # these one with few shingles of its own: the text that the others are copies of links to most of them
    lists, comp, done = probes.withColumn("far", F.lit(0)), None, []
    for turn in range(rounds + 1):
        if comp is None:
            placed = lists.withColumn("comp", F.col("node"))
        else:
            placed = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        # nearly all keys have one set, so sums by key before the exchange would only add to what is shuffled: entries meet once, and lists are judged where they lie
        by_key, tallest = Window.partitionBy("key"), F.struct(F.col("far") >= 10 * (100 - percent), "most", "node")
        judged = placed.withColumns({"lo": F.min("comp").over(by_key), "hi": F.max("comp").over(by_key), "pivot": F.max(tallest).over(by_key)["node"], "least": F.min("n").over(by_key), "most_": F.max("most").over(by_key)})
        live = judged.filter("lo < hi AND most >= least AND n <= most_").drop("lo", "hi", "least", "most_")
        live = stored(live, "jaccard-lists")
        forget(*done)
        if live.isEmpty():
            break
        if turn < rounds:
            pairs = live.filter("node != pivot").select("node", "pivot").distinct()
        else:
            pairs = _across(live)
        pairs = stored(pairs, "jaccard-candidates")
        left, right = items, items.select(F.col("node").alias("pivot"), F.col("n").alias("n2"), F.col("items").alias("items2"))
        if pairs.count() <= MOST_BROADCAST:  # few pairs: only their sets are shuffled
            left = left.join(F.broadcast(pairs.select("node").distinct()), "node", "left_semi")
            right = right.join(F.broadcast(pairs.select("pivot").distinct()), "pivot", "left_semi")
        both = pairs.join(left, "node").join(right, "pivot")
        both = both.select("node", "pivot", "n", "n2", F.size(F.array_intersect("items", "items2")).alias("common")).withColumn("all", F.col("n") + F.col("n2") - F.col("common"))
        apart = F.col("all") - F.col("common")
        width = 100 - percent
        seen = stored(both.select("node", "pivot", (100 * F.col("common") >= percent * F.col("all")).alias("link"), F.expr(f"(100L * (all - common)) div ({width} * all)").cast("int").alias("ring"), F.floor(1000 * apart / F.col("all")).cast("int").alias("far")), "jaccard-pairs")
        forget(pairs)
        comp = _merged(comp, seen.filter("link").select("node", "pivot"))
        done = [live, seen]
        if turn == rounds:
            continue
        ringed = live.filter("node != pivot").drop("comp", "far").join(seen, ["node", "pivot"]).select("key", "node", "n", "most", "ring", "far")
        mask = ringed.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, ring)")).alias("rings"))
        has = lambda r: F.getbit("rings", F.greatest(r, F.lit(0))).cast("boolean") & (r >= 0)
        here = F.col("ring")
        # group r holds the rings r and r + 1; a ring without neighbours is a group of its own
        groups = F.array(F.when(has(here + 1) | ~has(here - 1), here), F.when(has(here - 1), here - 1))
        lists = ringed.join(mask, "key").select(F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("g"), "key", "node", "n", "most", "far").select(F.xxhash64("key", "g").alias("key"), "node", "n", "most", "far")
    else:
        forget(*done)
    if comp is None:
        return sets.select("node", F.col("node").alias("root")).limit(0)
    return comp


def _across(live: DataFrame) -> DataFrame:
    """(node, pivot): the pairs of a list from different components that the bounds on sizes leave.

    One of such a pair lies outside the list's largest component. Those few look up, size by size, who may link to them."""
    largest = live.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members")).groupBy("key").agg(F.max(F.struct("members", "comp"))["comp"].alias("main"))
    sizes = live.groupBy("key", F.col("n").alias("n2")).agg(F.max("most").alias("reach"))
    outside = live.drop("pivot", "far").join(largest, "key").filter("comp != main").join(sizes, "key").filter("n2 <= most AND n <= reach")
    other = live.select("key", F.col("n").alias("n2"), F.col("node").alias("pivot"), F.col("comp").alias("comp2"), F.col("most").alias("most2"))
    pairs = outside.join(other, ["key", "n2"]).filter("comp != comp2 AND n <= most2")
    return pairs.select(F.least("node", "pivot").alias("node"), F.greatest("node", "pivot").alias("pivot")).distinct()


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after ``links`` join in; only components are walked over, never their members."""
    if comp is None:
        return components(links, "node", "pivot")
    to = comp.select(F.col("node").alias("pivot"), F.col("root").alias("root2"))
    lifted = links.join(comp, "node", "left").join(to, "pivot", "left").select(F.coalesce("root", "node").alias("a"), F.coalesce("root2", "pivot").alias("b"))
    up = components(lifted, "a", "b").withColumnsRenamed({"node": "old", "root": "new"})
    moved = comp.join(up, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = up.join(comp, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return stored(moved.unionByName(fresh), "jaccard-components")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, resting: bool = True) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id (all rows of that id stay, as they are one
    document). Documents without an id or without shingles all stay; columns of any name pass through."""
    groups = jaccard_components(docs, percent, words, id_col, text_col, block_bytes=block_bytes, resting=resting).filter((F.col("component_id") != F.col(id_col)) & (F.col("n_shingles") > 0))
    gone = groups.select(F.col(id_col).alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
