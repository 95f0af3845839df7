"""Reads of stored tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["env", "task_id"]
#: What a child needs of its parent.
PARENT_FIELDS = ["env", "task_id", "name", "parent_id", "primary_id", "parents_path", "orphan", "ctx"]


def count_by_name(tasks: DataFrame, name: str, env: str) -> int:
    return tasks.filter((F.col("name") == name) & (F.col("env") == env)).count()


def by_ids(tasks: DataFrame, ids: DataFrame, filters: list[Column] | None = None, must_not: list[Column] | None = None) -> DataFrame:
    """Tasks with one of the ids that pass all filters and none of ``must_not``.

    ``ids`` with an environment (env, task_id) stand for one task each, those without for the tasks of that id in all environments."""
    for f in filters or []:
        tasks = tasks.filter(f)
    for f in must_not or []:
        tasks = tasks.filter(~F.coalesce(f, F.lit(False)))
    key = [c for c in KEY if c in ids.columns]
    return tasks.join(ids.select(*key).distinct(), key, "left_semi")


def single_by_ids(tasks: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """As ``by_ids``; tasks in several generations are left out (``strict``) or taken from the newest one."""
    found = by_ids(tasks, ids)
    if strict:
        lone = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
        return found.join(lone.select(*KEY), KEY, "left_semi")
    newest = Window.partitionBy(*KEY).orderBy(F.desc("generation"))
    return found.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def get_task(tasks: DataFrame, task_id: str, strict: bool = True, env: str | None = None) -> DataFrame:
    """The task of an id in an environment, or in each one that has it."""
    return single_by_ids(get_all(tasks, task_id, env), tasks.sparkSession.createDataFrame([(task_id,)], "task_id string"), strict)


def get_all(tasks: DataFrame, task_id: str, env: str | None = None) -> DataFrame:
    found = tasks.filter(F.col("task_id") == task_id)
    return found if env is None else found.filter(F.col("env") == env)


def parents(tasks: DataFrame) -> DataFrame:
    return tasks.select(*PARENT_FIELDS)


def fields(tasks: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Columns by name; "ctx.*" and the like name a whole map, "ctx.key" one of its values, which ``include`` gives as a column
    of that name and ``exclude`` takes out of the map. A name that is excluded and is no column is passed over."""
    chosen = []
    for name in include or tasks.columns:
        column, dot, key = name.partition(".")
        chosen.append(F.col(column)[key].alias(name) if dot and key != "*" else F.col(column))
    gone: dict[str, list[str]] = {}
    for name in exclude or []:
        column, dot, key = name.partition(".")
        if not dot or key == "*":
            gone[column] = []
        elif gone.get(column, [key]):
            gone.setdefault(column, []).append(key)
    without = lambda c, keys: F.map_filter(c, lambda k, v: ~k.isin(keys))
    tasks = tasks.withColumns({c: without(c, keys) for c, keys in gone.items() if keys and c in tasks.columns})
    return tasks.select(*chosen).drop(*[c for c, keys in gone.items() if not keys])


def as_numbers(metrics: Column) -> Column:
    """Metrics as text in the form they were stored in: whole numbers without a point."""
    return F.transform_values(metrics, lambda k, v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string")))


def top_counts(tasks: DataFrame, column: str, top: int) -> DataFrame:
    return tasks.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column).limit(top)


def subtree_rollup(tree: DataFrame) -> DataFrame:
    """Per root: tasks below and including it, deepest level, orphans aside."""
    return tree.filter("primary_id IS NOT NULL").groupBy("primary_id").agg(F.count(F.lit(1)).alias("tasks"), F.max("depth").alias("max_depth"))
