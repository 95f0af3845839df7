"""Sharding by a keyed permutation of row numbers (operator 2, native).

Every row gets a global row number from 0, in an order that only its content decides. A Feistel network
over the smallest domain of whole bits that holds all numbers, with cycle walking back into the range,
permutes the numbers; the permuted number gives shard and slot by division. Anyone who knows the number
of rows and the seed can compute where a row number lies, without a table.

The law is ``rows``: any two shards differ by one row at most, and slots have no gaps.

Row numbers without a global sort: rows fall into ``BUCKETS`` buckets by a hash of their content, the buckets are
counted (one row per bucket, so what is summed up and joined back has a fixed bound), and rows are numbered
within their bucket. Nothing depends on Spark's partitions, so a lost task gives the same numbers again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import shuffle_partitions, stored, table

BUCKETS = 4096
#: Round keys: odd multipliers below 2^31 and offsets, fixed so that the order can be reproduced.
ROUNDS = 8
#: The prime that the round function works by; its products stay below 2^63.
PRIME = (1 << 31) - 1
#: Steps of one cycle walk. Fewer than half of the domain's numbers lie outside the range, so a walk needs
#: t more steps with a probability below 2^-t; should one ever need more, the query fails and drops nothing.
WALK = 96


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(multiplier, offset) for each round, by a linear congruential rule from the seed."""
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(rounds):
        a = x = (x * 48271 + 11) % PRIME
        c = x = (x * 48271 + 11) % PRIME
        keys.append((a | 1, c % (1 << 28)))
    return keys


def _mixed(x: Column, a: Column, c: Column) -> Column:
    v = (x * a + c) % F.lit(PRIME)
    return (v * (F.shiftright(v, 3) + c)) % F.lit(PRIME)


def feistel(x: Column, n: Column, seed: int = 0, backwards: bool = False) -> Column:
    """``x`` (0 <= x < n) permuted within 0 .. n-1, or its place before that; ``n`` is at most 2^60."""
    # bits of the domain: halves of low and high bits, of equal size or one more below
    bits = F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")
    low = F.ceil(bits / F.lit(2)).cast("int")
    one = F.lit(1).cast("long")
    mask = lambda b: F.expr("1L") * F.pow(F.lit(2.0), b).cast("long") - one
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c"), F.lit(a2).cast("long").alias("a2"), F.lit(c2).cast("long").alias("c2")) for (a, c), (a2, c2) in list(zip(*[iter(round_keys(seed))] * 2))[:: -1 if backwards else 1]])
    # what holds for all rounds is computed once per row and handed through the folds
    start = F.struct(x.cast("long").alias("v"), mask(low).alias("ml"), mask(bits - low).alias("mh"), F.pow(F.lit(2.0), low).cast("long").alias("size"), n.cast("long").alias("n"))

    def network(s: Column) -> Column:
        halves = F.struct((s["v"] % s["size"]).alias("l"), F.floor(s["v"] / s["size"]).cast("long").alias("h"))

        def high_round(acc: Column, k: Column) -> Column:
            h = acc["h"].bitwiseXOR(_mixed(acc["l"], k["a"], k["c"]).bitwiseAND(s["mh"]))
            return F.struct(acc["l"].alias("l"), h.alias("h"))

        def low_round(acc: Column, k: Column) -> Column:
            return F.struct(acc["l"].bitwiseXOR(_mixed(acc["h"], k["a2"], k["c2"]).bitwiseAND(s["ml"])).alias("l"), acc["h"].alias("h"))

        first, second = (low_round, high_round) if backwards else (high_round, low_round)
        return F.aggregate(keys, halves, lambda acc, k: F.transform(F.array(first(acc, k)), lambda t: second(t, k))[0], lambda acc: acc["h"] * s["size"] + acc["l"])

    def step(s: Column, i: Column) -> Column:
        walked = F.struct(network(s).alias("v"), s["ml"].alias("ml"), s["mh"].alias("mh"), s["size"].alias("size"), s["n"].alias("n"))
        return F.when((i > 0) & (s["v"] < s["n"]), s).otherwise(walked)

    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), start, step, lambda s: F.when(s["v"] < s["n"], s["v"]).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long")))


#: Copies of a row that are made again from one count at a time.
PART_ROWS = 4096


def row_numbers(rows: DataFrame, by: list[str], number: str = "row_number", total: str = "n_rows", copies: str | None = None) -> DataFrame:
    """``rows`` with ``number``, gapless from 0 over all rows, and ``total``, their count.

    The order is that of an MD5 of the columns ``by`` and then of these columns, nulls first. Rows equal in
    all of ``by`` are interchangeable and get numbers in a row. With ``copies``, a column of counts, a row stands for so many and
    gets the first of their numbers; so a window never holds equal rows."""
    n = F.lit(1).cast("long") if copies is None else F.col(copies)
    key = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by]))
    # three digits: BUCKETS buckets in the order of the keys
    keyed = rows.withColumn("__h", key).withColumn("__bucket", F.substring("__h", 1, 3))
    counts = keyed.groupBy("__bucket").agg(F.sum(n).alias("__n"))  # at most BUCKETS rows
    ends = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("__bucket", (F.sum("__n").over(ends) - F.col("__n")).alias("__start"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias(total))
    within = Window.partitionBy("__bucket").orderBy("__h", *by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = keyed.withColumn("__i", F.sum(n).over(within) - n)
    # the broadcast side has one row of three values per bucket: BUCKETS rows at any size of the data
    joined = numbered.join(F.broadcast(starts), "__bucket")
    return joined.withColumn(number, F.col("__start") + F.col("__i")).drop("__h", "__bucket", "__i", "__start")


def place_of(row_number: Column, n_rows: Column, n_shards: int = 16, seed: int = 7) -> tuple[Column, Column]:
    """(shard, slot) of a row number."""
    permuted = feistel(row_number, n_rows, seed)
    return (permuted % n_shards).cast("int"), F.floor(permuted / n_shards).cast("long")


def row_number_at(shard: Column, slot: Column, n_rows: Column, n_shards: int = 16, seed: int = 7) -> Column:
    """The row number that lies in this slot of this shard: the network run backwards."""
    return feistel(slot * n_shards + shard, n_rows, seed, backwards=True)


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: id_col, size, text_crc32, law, shard, slot, grown_shard, and the row number.

    A null text has size 1 and the CRC of the empty string; null ids are ids like any other; repeated rows are
    separate rows of the permutation; an empty table gives no rows. ``grown_shard`` is null, as it belongs to
    another law. Only id, length and checksums are shuffled, never texts; other columns are not read. Rows with equal id and text are
    numbered as one row with a count and made again from it, many of them in parts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"))
    at, slot = place_of(F.col("row_number"), F.col("n_rows"), n_shards, seed)
    kinds = rows.groupBy("id", "digest", "size", "crc").agg(F.count(F.lit(1)).alias("copies"))
    first = stored(row_numbers(kinds, ["id", "digest"], copies="copies").drop("digest"), "shard-kinds")
    begin = F.coalesce("part", F.lit(0)).cast("long") * PART_ROWS
    again = lambda some: some.withColumn("k", F.explode(F.sequence(begin, F.least(begin + PART_ROWS, F.col("copies")) - 1))).withColumn("row_number", F.col("row_number") + F.col("k")).drop("k", "part")
    few = first.filter(F.col("copies") <= PART_ROWS).withColumn("part", F.lit(None).cast("long"))
    many = first.filter(F.col("copies") > PART_ROWS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PART_ROWS))))
    placed = again(few).unionByName(again(many.repartition(shuffle_partitions(docs), "row_number", "part")))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), at.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("row_number").cast("long").alias("row_number"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """CRC-32 of four bits."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return table


def _network_sql(seed: int) -> str:
    """The network over l and h as nested queries; ``ml``, ``mh`` are the masks of the halves."""
    mixed = lambda v, a, c: f"(({v} * {a} + {c}) % {PRIME}) * (((({v} * {a} + {c}) % {PRIME}) >> 3) + {c}) % {PRIME}"
    query = "SELECT *, v % size AS l, v // size AS h FROM ({})"
    for i, (a, c) in enumerate(round_keys(seed)):
        new = f"xor(h, ({mixed('l', a, c)}) & mh) AS h" if i % 2 == 0 else f"xor(l, ({mixed('h', a, c)}) & ml) AS l"
        query = f"SELECT * REPLACE ({new}) FROM ({query})"
    return f"SELECT * REPLACE (h * size + l AS v) FROM ({query})"


OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest FROM documents),
x AS (SELECT *, string_split(hex(encode(text)), '') AS digits FROM d),
c AS (SELECT *, list_reduce(list_transform(range(0, 2 * strlen(text)), lambda i: position(digits[(i + 1 - 2 * (i % 2) + 1)::BIGINT] IN '0123456789ABCDEF') - 1), lambda a, b: xor(a >> 4, {_crc_table()}[(xor(a, b) & 15) + 1]), 4294967295::BIGINT) AS crc FROM x),
n AS (SELECT doc_id, strlen(text)::BIGINT + 1 AS size_, xor(crc, 4294967295)::BIGINT AS text_crc32, row_number() OVER (ORDER BY md5(concat(coalesce(doc_id::VARCHAR, '-'), ':', digest)), doc_id NULLS FIRST) - 1 AS row_number, count(*) OVER () AS n_rows FROM c),
b AS (SELECT *, CASE WHEN n_rows <= 1 THEN 0 ELSE length(bin(n_rows - 1)) END AS bits FROM n),
f AS (SELECT row_number, n_rows, row_number AS v, (1::BIGINT << ((bits + 1) // 2)) AS size, (1::BIGINT << ((bits + 1) // 2)) - 1 AS ml, (1::BIGINT << (bits // 2)) - 1 AS mh, 0 AS steps FROM b),
w AS (SELECT * FROM f UNION ALL
      SELECT row_number, n_rows, v, size, ml, mh, steps + 1 FROM ({_network_sql(7).format("SELECT * FROM w WHERE steps = 0 OR v >= n_rows")}))
SELECT doc_id, size_ AS size, text_crc32, 'rows' AS law, (v % 16)::INT AS shard, (v // 16)::BIGINT AS slot, NULL::INT AS grown_shard, b.row_number::BIGINT AS row_number
FROM b JOIN w ON w.row_number = b.row_number AND w.steps > 0 AND w.v < w.n_rows
"""
