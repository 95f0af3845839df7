"""Connected components by alternating stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FEW_ROWS, join_owners, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the least node of its component.

    Each step hangs the larger neighbours of every node, then the smaller ones, below the least of them, until
    nothing changes: a logarithmic number of steps, each linear in the edges. The least neighbour comes from a
    partial aggregation; the join back deals a hot node's edges out (``join_owners``). Every step starts
    from stored files, so its lineage stays short."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "components")
    before = _stats(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_owners(both, least, ["u"], "n", most=2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stored(large, "components-large") if 2 * before[0] > FEW_ROWS else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_owners(large, least, ["u"], "n", most=2 * before[0])
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, "components")
        after = _stats(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stats(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
