"""Cleaning of events, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M


def repair_id(task_id: Column, suffix: str = M.ID_SUFFIX) -> Column:
    """Ids that end in the suffix twice, then once, lose all its occurrences."""
    for s in (suffix * 2, suffix):
        task_id = F.when(F.endswith(task_id, F.lit(s)), F.replace(task_id, F.lit(s), F.lit(""))).otherwise(task_id)
    return task_id


def name_of(name: Column, task_id: Column, suffix: str = M.ID_SUFFIX) -> Column:
    """The name, or what the id says: the part before "___", else all but the last two parts between "_".

    An id of one such part is its own name."""
    short = F.when(F.endswith(task_id, F.lit(suffix)), F.left(task_id, F.length(task_id) - len(suffix))).otherwise(task_id)
    parts = F.split(short, "_")
    from_parts = F.when(F.size(parts) < 2, task_id).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "_"))
    return F.coalesce(name, F.when(F.contains(short, F.lit(M.ID_DELIMITER)), F.split_part(short, F.lit(M.ID_DELIMITER), F.lit(1))).otherwise(from_parts))


def plain_keys(m: Column) -> Column:
    """"." in keys becomes "_", a null map an empty one. Of keys that become equal, the greatest original one wins."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(F.replace(e["key"], F.lit("."), F.lit("_")).alias("k"), e["key"].alias("o"), e["value"].alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    last = F.transform(F.array(entries), lambda s: F.filter(s, lambda x, i: ~F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False))))[0]
    return F.when(m.isNull(), F.map_from_arrays(F.array(), F.array())).otherwise(F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))))


def trim_values(m: Column, chars: int) -> Column:
    return F.transform_values(m, lambda k, v: F.substring(v, 1, chars))


def clean_metrics(m: Column) -> Column:
    """NaN becomes 0, nulls go, infinities stay."""
    return F.transform_values(F.map_filter(m, lambda k, v: v.isNotNull()), lambda k, v: F.when(F.isnan(v), F.lit(0.0)).otherwise(v))


def merge_maps(old: Column, new: Column) -> Column:
    """Union with the new value for keys of both; a null map is empty. Needs no setting of the session."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def retention(date: Column, now: Column, days: int) -> Column:
    """Midnight of the given date, or of ``now`` and at least one day."""
    return F.date_trunc("day", F.coalesce(date, now + F.make_dt_interval(F.lit(max(days, 1)))))


def store_env(env: Column) -> Column:
    return F.lower(F.coalesce(env, F.lit(M.DEFAULT_ENV)))


def estimated_size(e: DataFrame) -> Column:
    """Characters that an event has as JSON, estimated from its fields as clients do to bound their batches."""
    plain = lambda c, n: F.coalesce(F.length(c) + n, F.lit(0))
    total = lambda lens: F.greatest(F.aggregate(lens, F.lit(0), lambda a, x: a + x) - 1, F.lit(0))
    strings = lambda c: total(F.transform(F.map_entries(c), lambda x: F.coalesce(F.length(x["key"]) + F.length(x["value"]) + 6, F.lit(0))))
    numbers = lambda c: total(F.transform(F.map_entries(c), lambda x: F.length(x["key"]) + F.coalesce(F.length(x["value"].cast("string")) + 5, F.lit(0))))
    size = F.length("type") + F.lit(13 + 34)
    for c, n in (("primary_id", 15), ("task_id", 12), ("name", 10), ("parent_id", 14), ("env", 8)):
        size = size + plain(e[c], n)
    for c, n, f in (("strings", 13, strings), ("text", 10, strings), ("context", 13, strings), ("metrics", 13, numbers)):
        size = size + F.when(e[c].isNull(), 0).otherwise(f(e[c]) + n)
    path = total(F.transform(e["parents_path"], lambda x: F.length(x) + 3))
    size = size + F.when(e["parents_path"].isNull(), 0).otherwise(path + 14)
    return size + F.when(e["orphan"].isNull(), 0).otherwise(16) + F.when(e["date_to_delete"].isNull(), 0).otherwise(42)


def normalize(events: DataFrame, suffix: str = M.ID_SUFFIX) -> DataFrame:
    """Events without ids go; then ids, keys, values, metrics and environments are cleaned, in this order."""
    maps = {c: plain_keys(F.col(c)) for c in M.MAPS}
    for c, chars in (("strings", M.MAX_KEYWORD_CHARS), ("context", M.MAX_KEYWORD_CHARS), ("text", M.MAX_TEXT_CHARS)):
        maps[c] = trim_values(maps[c], chars)
    maps["metrics"] = clean_metrics(maps["metrics"])
    ids = {c: repair_id(F.col(c), suffix) for c in ("task_id", "parent_id")}
    return events.filter(F.col("task_id").isNotNull()).withColumns(ids | maps | {"env": store_env(F.col("env"))})
