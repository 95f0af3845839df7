"""The task tree: roots, paths, inherited context, orphans and their adoption.

Ids may be of any type that can be joined: where ids of several environments come together, they are structs of
environment and id (``scoped``), so that a tree never crosses environments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import merge_maps
from ..sources.files import stored


def scoped(task_id: str, env: str = "env") -> Column:
    """An id within its environment; null stays null."""
    return F.when(F.col(task_id).isNotNull(), F.struct(F.col(env).alias("env"), F.col(task_id).alias("id")))


def missing_parents(nodes: DataFrame) -> DataFrame:
    """parent_id of parents that are not among the nodes."""
    return orphan_index(nodes).select("parent_id")


def orphan_index(nodes: DataFrame) -> DataFrame:
    """parent_id, waiting children and the least of them, for parents that have not come.

    Children are counted before the join, so a hot parent is one row of it."""
    asked = nodes.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).alias("waiting"), F.min("task_id").alias("first_child"))
    return asked.join(nodes.select(F.col("task_id").alias("parent_id")), "parent_id", "left_anti")


def _tops(nodes: DataFrame) -> DataFrame:
    """task_id, top, depth of nodes that reach a root, by doubling: after k joins a node knows 2^k ancestors.

    Nodes below a missing parent or in a cycle never reach one. Only ids travel. Ids are unique, so no join has an aggregation
    between its exchange and its sort, and Spark splits the partition of a hot parent where it is large enough."""
    known = nodes.select(F.col("task_id").alias("parent_id"), F.lit(True).alias("there"))
    now = nodes.select("task_id", "parent_id").join(known, "parent_id", "left").select("task_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), (F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("lost"), F.lit(0).alias("depth"))
    now = stored(now.withColumns({"depth": F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long"), "top": F.coalesce("up", "task_id")}), "tree")
    rounds = math.ceil(math.log2(max(2, now.count()))) + 1
    for _ in range(rounds):
        # who still points to someone that points further up
        if now.filter("up IS NOT NULL").isEmpty():
            break
        done, open_ = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
        far = now.select(F.col("task_id").alias("up"), F.col("up").alias("up2"), F.col("lost").alias("lost2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        moved = open_.join(far, "up").select("task_id", F.col("up2").alias("up"), F.col("lost2").alias("lost"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("top2").alias("top"))
        now = stored(done.select("task_id", "up", "lost", "depth", "top").unionByName(moved), "tree")
    return now.filter("up IS NULL AND NOT lost").select("task_id", "top", "depth")


def _resolved(nodes: DataFrame) -> DataFrame:
    """task_id, primary_id, depth, name, ctx, path (empty for roots) of those nodes that reach a root."""
    tops = _tops(nodes)
    depths = tops.agg(F.max("depth")).first()[0] or 0
    tree = nodes.join(tops, "task_id").select("task_id", F.col("parent_id").alias("up"), F.col("top").alias("primary_id"), "depth", "name", "ctx", F.array().cast("array<string>").alias("path"))
    tree = stored(tree, "paths")
    # payload doubles in the same way: a node's segment covers its next 2^k ancestors. Those whose segment ends at the root are not joined
    for _ in range(math.ceil(math.log2(depths + 1)) if depths else 0):
        far = tree.select(F.col("task_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("name").alias("name2"), F.col("ctx").alias("ctx2"))
        moved = tree.filter("up IS NOT NULL").join(far, "up").select("task_id", F.col("up2").alias("up"), "primary_id", "depth", "name", merge_maps(F.col("ctx2"), F.col("ctx")).alias("ctx"), F.concat("path2", F.array("name2"), "path").alias("path"))
        tree = stored(tree.filter("up IS NULL").unionByName(moved), "paths")
    return tree.drop("up")


def resolve(nodes: DataFrame, context: str = "ctx", carried: tuple[str, ...] = ()) -> DataFrame:
    """task_id, parent_id, name, primary_id, parents_path, depth, ctx, orphan (and columns to be ``carried`` along) from started tasks
    (task_id, parent_id, name and a map of their own context; ids unique).

    A root is its own primary and has no path. Below a root, the path is the parent's path and name, the primary is the
    root, and keys of the context that a task lacks come from its nearest ancestor that has them. Others are orphans.

    Only nodes that have children go through the doubling; most nodes of a wide tree have none, and all take what they inherit from their
    parent in one join, as roots do without any."""
    nodes = nodes.select("task_id", "parent_id", "name", F.col(context).alias("ctx"), *carried)
    below = nodes.filter("parent_id IS NOT NULL")
    parents = below.select(F.col("parent_id").alias("task_id")).distinct()
    inner = stored(nodes.drop(*carried).join(parents, "task_id", "left_semi"), "inner")
    up = _resolved(inner).select(F.col("task_id").alias("parent_id"), F.col("primary_id").alias("top"), F.col("depth").alias("level"), F.col("name").alias("name2"), F.col("ctx").alias("ctx2"), "path", F.lit(True).alias("there"))
    joined = below.join(up, "parent_id", "left").select(
        "task_id", "parent_id", "name", F.col("top").alias("primary_id"), F.concat("path", F.when(F.col("there"), F.array("name2"))).alias("parents_path"), (F.col("level") + 1).alias("depth"),
        F.when(F.col("there"), merge_maps(F.col("ctx2"), F.col("ctx"))).otherwise(F.col("ctx")).alias("ctx"), F.when(F.col("there").isNull(), True).alias("orphan"), *carried,
    )
    own = {"primary_id": F.col("task_id"), "parents_path": F.lit(None).cast("array<string>"), "depth": F.lit(0).cast("long"), "orphan": F.lit(None).cast("boolean")}
    return nodes.filter("parent_id IS NULL").withColumns(own).select(*joined.columns).unionByName(joined)


def adopt(stored_tasks: DataFrame, batch: DataFrame, context: str = "ctx") -> DataFrame:
    """The tree after ``batch`` has come to ``stored_tasks`` (resolved before): orphans whose line to a root is now
    whole are adopted (orphan false), down to their last descendants."""
    old = stored_tasks.select("task_id", "parent_id", "name", F.col(context).alias("ctx"), F.col("orphan").alias("was"))
    new = batch.select("task_id", "parent_id", "name", F.col(context).alias("ctx"), F.lit(None).cast("boolean").alias("was")).join(old.select("task_id"), "task_id", "left_anti")
    return resolve(old.unionByName(new), carried=("was",)).withColumn("orphan", F.when(F.col("orphan"), True).when(F.col("was"), False).otherwise(F.when(F.col("was").isNotNull(), F.col("was")))).drop("was")
