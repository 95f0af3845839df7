"""Mixing sources to target weights by Poisson replication (operator 1, native).

Each source gets a mean repetition rate: its target share of the output over its actual share of the
input. A document's number of copies is Poisson with that mean, drawn by inverting the distribution function
at a uniform number that is a hash of seed and document. So the draw needs no state, gives the same counts
on every run, and any task can redo it. The copies are exploded and dealt out in a global random order.

A document is known by its id, its text and, among rows that agree in both, its position; so rows without an id or
with a repeated one have draws and places of their own, too. Positions are only worked out for such rows, and equal ones of
these are counted, not gathered.

Sums per source are the only other thing aggregated (with partial sums before the shuffle). The rates are broadcast
while there are at most ``MOST_BROADCAST`` sources; for more, Spark sorts and merges, and each source's rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import free_name, join_owners, stored, table

#: The largest mean that one inversion handles; a larger one is a sum of independent draws, which is exact.
MEAN_PER_DRAW = 32.0
#: Equal rows that one task gives positions to at a time.
POSITIONS = 10_000
#: Sources whose rates are broadcast (a name and a number each).
MOST_BROADCAST = 100_000


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over the seed and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, seed: int, *keys: Column) -> Column:
    """A Poisson count with this mean (null or below zero: 0) from the hash of seed and keys."""
    draws = F.greatest(F.ceil(mean / MEAN_PER_DRAW), F.lit(0)).cast("int")

    def one(draw: Column) -> Column:
        m = mean / draws
        u = uniform(seed, *keys, draw)
        # beyond this many terms less than 2^-53 of the distribution is left
        terms = F.sequence(F.lit(1), F.ceil(m + F.lit(12.0) * F.sqrt(m) + F.lit(24.0)).cast("int"))
        p0 = F.exp(-m)
        start = F.struct(F.lit(0).cast("long").alias("k"), p0.alias("p"), p0.alias("cdf"), u.alias("u"), m.alias("m"))
        step = lambda s, i: F.when(s["u"] < s["cdf"], s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * s["m"] / i).alias("p"), (s["cdf"] + s["p"] * s["m"] / i).alias("cdf"), s["u"].alias("u"), s["m"].alias("m")))
        return F.aggregate(terms, start, step, lambda s: s["k"])

    total = F.aggregate(F.transform(F.sequence(F.lit(1), draws), one), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(mean > 0, total).otherwise(F.lit(0).cast("long"))


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: float = 1.0, source_col: str = "source") -> DataFrame:
    """source, n_rows and rate per source. ``weights`` are target shares by source, made to sum to 1 over the
    sources present (a source without one gets none); without ``weights`` a source's share is its number of rows to
    the power ``temperature``. ``total`` is the size of the output as a multiple of the input. A null source is a source; its weight
    is that of the key None."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        share = F.pow(F.col("n_rows").cast("double"), F.lit(temperature))
    else:
        named = {k: v for k, v in weights.items() if k is not None}
        share = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("source")] if named else F.lit(None).cast("double")
        share = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(share, F.lit(0.0)))
    counts = counts.withColumn("share", share)
    sums = counts.agg(F.sum("share").alias("shares"), F.sum("n_rows").alias("rows"))
    return counts.crossJoin(F.broadcast(sums)).select(  # one row of sums
        "source", "n_rows", F.when(F.col("shares") > 0, F.lit(total) * F.col("share") / F.col("shares") * F.col("rows") / F.col("n_rows")).otherwise(F.lit(0.0)).alias("rate")
    )


def _placed(docs: DataFrame, id_col: str, text_col: str | None) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), ``id``, ``text`` (the text's MD5) and ``position`` among rows that agree in both.

    Positions go by a hash of all other columns; rows equal in this, too, are one group with a count, from which they are made
    again: as such rows are alike, it is all the same which is which. Maps take no part in the hash, so rows
    that differ in a map alone are made again from one of them."""
    names = [f"`{c}`" for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    text = F.md5(F.coalesce(F.col(text_col), F.lit(""))) if text_col in docs.columns else F.lit("")
    rows = docs.select(F.struct(*map(F.col, names)).alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(*hashed).alias("tie"))
    repeated = stored(rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("id2"), F.col("text").alias("text2")), "mixing-repeated")
    same = rows["id"].eqNullSafe(repeated["id2"]) & (rows["text"] == repeated["text2"])
    alone = rows.join(repeated, same, "left_anti").select("row", "id", "text", F.lit(1).cast("long").alias("position"))
    if repeated.isEmpty():
        return rows.select("row", "id", "text", F.lit(1).cast("long").alias("position"))
    groups = rows.join(repeated, same, "left_semi").groupBy("id", "text", "tie").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
    # one row per kind of row that repeats an id and a text
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id", "text").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("before", before)
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / POSITIONS)))).repartition("id", "text", "tie", "part")
    first = F.col("part") * POSITIONS + 1
    again = parts.withColumn("k", F.explode(F.sequence(first, F.least(first + POSITIONS - 1, F.col("n")))))
    return alone.unionByName(again.select("row", "id", "text", (F.col("before") + F.col("k")).cast("long").alias("position")))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: float = 1.0, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", count_only: bool = False, text_col: str | None = "text") -> DataFrame:
    """``docs`` with each row as often as its Poisson count says, in a global random order, and __copy (from 1),
    __copies, __rate and __order.

    Counts depend on seed, id, text and the position among rows that agree in these alone (``_placed``), so every row has a
    draw of its own, and no two copies share a place but by chance of the hash. Columns and types of ``docs`` stay, whatever their
    names: where ``docs`` has a column __copy, the new one is ___copy, and so on. An empty table gives no rows; a rate of 0 gives none either."""
    counts = repetition_rates(docs, weights, temperature, total, source_col).select(F.col("source").alias("from"), "rate", "n_rows")
    rates = stored(counts, "mixing-rates")
    placed = _placed(docs, id_col, text_col).withColumn("from", F.col("row")[source_col])
    if rates.count() <= MOST_BROADCAST:
        known = F.broadcast(rates.select(F.col("from").alias("from2"), "rate"))
        drawn = placed.join(known, F.col("from").eqNullSafe(F.col("from2")), "inner").drop("from2")
    else:  # null becomes a key like any other
        key = F.struct(F.col("from").isNull(), F.coalesce(F.col("from").cast("string"), F.lit("")))
        drawn = join_owners(placed.withColumn("key", key), rates.select(key.alias("key"), "rate", "n_rows"), ["key"], "n_rows").drop("key")
    drawn = drawn.withColumn("copies", poisson(F.col("rate"), seed, F.col("id"), F.col("text"), F.col("position")))
    copies = drawn.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    order = copies.withColumn("order", uniform(seed + 1, F.col("id"), F.col("text"), F.col("position"), F.col("copy")))
    if not count_only:
        order = order.repartitionByRange(F.col("order")).sortWithinPartitions("order", "id", "copy")
    given = [F.col("row")[c].alias(c) for c in docs.columns]
    return order.select(*given, *[F.col(c).alias(free_name(f"__{c}", docs.columns)) for c in ("copy", "copies", "rate", "order")])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per emitted copy of a document. Whole rows are dealt, shuffled and written in their order to a table in the
    shared folder, the mixture itself; the query returns its ids, in the same order."""
    mixed = stored(mix(table(spark, sf_dir, "documents")), "mixing-rows")
    ids = mixed.select("doc_id", "source", F.col("__copy").alias("copy"), F.col("__copies").alias("copies"), F.round("__rate", 9).alias("rate"), F.col("__order").alias("order_key"))
    # Spark reads a table's files in any order
    return ids.repartitionByRange("order_key").sortWithinPartitions("order_key", "doc_id", "copy")


_KEY = "coalesce(doc_id::VARCHAR, '-'), ':', text, ':', position::VARCHAR"
OP1_SQL = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n_rows, pow(count(*)::DOUBLE, 0.5) AS share FROM documents GROUP BY source),
s AS (SELECT sum(share) AS shares, sum(n_rows) AS n FROM c),
r AS (SELECT source, 1.0::DOUBLE * share / shares * n / n_rows AS rate FROM c, s),
p AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text, row_number() OVER (PARTITION BY doc_id, text ORDER BY source) AS position FROM documents),
d AS (SELECT doc_id, p.source, text, position, rate, greatest(ceil(rate / 32.0), 0)::INT AS draws
      FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source),
i AS (SELECT *, unnest(range(1, draws + 1)) AS draw FROM d),
one AS (SELECT doc_id, source, text, position, rate, draw, rate / draws AS m,
               ('0x' || substr(md5(concat('11:', {_KEY}, ':', draw::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
        FROM i),
inv AS (SELECT doc_id, source, text, position, rate, draw, m, u, 0 AS k, exp(-m) AS p, exp(-m) AS cdf FROM one
        UNION ALL
        SELECT doc_id, source, text, position, rate, draw, m, u, k + 1, p * m / (k + 1), cdf + p * m / (k + 1) FROM inv
        WHERE NOT u < cdf AND k < ceil(m + 12.0 * sqrt(m) + 24.0)),
drawn AS (SELECT doc_id, source, text, position, rate, draw, max(k) AS k FROM inv GROUP BY ALL),
n AS (SELECT doc_id, source, text, position, rate, sum(k)::BIGINT AS copies FROM drawn GROUP BY doc_id, source, text, position, rate),
e AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
SELECT doc_id, source, copy::BIGINT AS copy, copies, round(rate, 9) AS rate,
       ('0x' || substr(md5(concat('12:', {_KEY}, ':', copy::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS order_key
FROM e
"""
