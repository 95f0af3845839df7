"""Generations of stored tasks: expiry, roll-over, merging of parts, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from .merge import upserted


def partials(tasks: DataFrame, now: Column, older_than: str = "1 minute") -> DataFrame:
    """Parts of tasks that began some time ago."""
    return tasks.filter(F.col("status").isin(*M.PARTIALS) & (F.col("task_begin") <= now - F.expr(f"INTERVAL {older_than}")))


def expired(tasks: DataFrame, now: Column) -> Column:
    return F.coalesce(tasks["date_to_delete"] <= now, F.lit(False))


def expired_by_generation(tasks: DataFrame, now: Column, top: int) -> DataFrame:
    """The ``top`` generations with the most expired tasks (the later one of equal ones)."""
    return tasks.filter(expired(tasks, now)).groupBy("generation").agg(F.count(F.lit(1)).alias("expired")).orderBy(F.desc("expired"), F.desc("generation")).limit(top)


def delete_expired(tasks: DataFrame, now: Column, top: int | None = None) -> DataFrame:
    """Tasks without the expired ones, of the ``top`` generations only if given."""
    gone = expired(tasks, now)
    if top is not None:
        worst = [r["generation"] for r in expired_by_generation(tasks, now, top).collect()]  # ``top`` rows
        gone = gone & F.coalesce(F.col("generation").isin([g for g in worst if g is not None]) | (F.col("generation").isNull() & F.lit(None in worst)), F.lit(False))
    return tasks.filter(~gone)


def delete_by_ids(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tasks without those of ``ids`` (env, task_id); equal ids in other environments are other tasks."""
    return tasks.join(ids.select("env", "task_id").distinct(), ["env", "task_id"], "left_anti")


def merge_generations(current: DataFrame, old: DataFrame, now: Column, monotone: bool = False) -> tuple[DataFrame, DataFrame]:
    """(current, old) after parts in one that have their counterpart in the other were brought together in the current one."""
    keys = ["env", "task_id"]
    p_now, p_old = partials(current, now).select(*keys), partials(old, now).select(*keys)
    matched = p_now.join(old.select(*keys), keys, "left_semi").unionByName(p_old.join(current.select(*keys), keys, "left_semi")).distinct()
    moved = old.join(matched, keys, "left_semi")
    return upserted(current, moved, monotone), old.join(matched, keys, "left_anti")


def rollover_plan(tasks: DataFrame, max_docs: int, max_age: str, size: Column, max_bytes: int) -> DataFrame:
    """Generation statistics and whether the next batch has to start a new one: age, count or bytes over their limit."""
    g = tasks.groupBy("generation").agg(F.count(F.lit(1)).alias("docs"), F.sum(size).cast("long").alias("bytes"), F.min("task_begin").alias("first"), F.max("task_begin").alias("last"))
    return g.withColumn("rollover", (F.col("docs") > max_docs) | (F.col("bytes") > max_bytes) | (F.col("last") - F.col("first") > F.expr(f"INTERVAL {max_age}")))


def compact(source: DataFrame, destination: DataFrame, now: Column) -> DataFrame:
    """``destination`` with the tasks of ``source`` whose ids it does not have, without those deleted before ``now``; one without a date
    never expires."""
    alive = source.filter(F.col("date_to_delete").isNull() | (F.col("date_to_delete") >= now))
    return destination.unionByName(alive.join(destination.select("env", "task_id"), ["env", "task_id"], "left_anti"))


def mergeable(sizes: dict[int, int], held: set[int], max_bytes: int, percent: int = 10) -> list[tuple[int, int]]:
    """Neighbouring pairs of small generations that no alias holds, to be compacted (first into second)."""
    small = sorted(g for g, n in sizes.items() if g not in held and n * 100 < max_bytes * percent)
    return list(zip(small[::2], small[1::2]))


def packed(sizes: dict[int, int], held: set[int], most: int) -> list[list[int]]:
    """Runs of neighbouring generations that fit together into ``most``; held ones stay alone and part their neighbours.

    A run is as long as fits, so a run and what follows it never fit together, unless a held one lies between."""
    runs: list[list[int]] = []
    for g in sorted(sizes):
        if runs and g not in held and runs[-1][-1] not in held and sum(sizes[x] for x in runs[-1]) + sizes[g] <= most:
            runs[-1].append(g)
        else:
            runs.append([g])
    return runs
