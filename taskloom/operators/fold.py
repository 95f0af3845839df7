"""Events folded to tasks.

Without spots the status machine has a closed form, so a task is a handful of counts, minima and first values:
partial aggregation does the work, and a task with a third of all events is no different from others. Only tasks
with a spot among other events, whose status a spot sets anew, are walked through in order, in slices, from
their last spot on.

The sums are written once and read again where they are joined to events, so that Spark can split the partition of a hot task.
Sums have fixed widths and are aggregated by hash; a second pass fetches the few strings that they point at. Names, parents and paths
of a task are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import normalize as N
from ..sources.files import kept_apart, stored

KEY = ["env", "task_id"]


def _key(value: str) -> Column:
    """A 64-bit hash that stands for a value where values are only compared within a task; null for null."""
    return F.when(F.col(value).isNotNull(), F.xxhash64(value))


def prepared(events: DataFrame, suffix: str = M.ID_SUFFIX) -> DataFrame:
    """Events with ``begin``, ``end`` (times that count as such), ``is_start`` and hashes of their own and known name and of their parent."""
    spot = F.col("type") == M.SPOT
    e = events.withColumns(
        {
            "known_name": N.name_of(F.col("name"), F.col("task_id"), suffix),
            "is_start": F.col("type").isin(M.START, M.SPOT),
            "begin": F.when(F.col("type").isin(M.START, M.SPOT), F.col("time")),
            "end": F.when(F.col("type").isin(M.SUCCESS_EVENT, M.ERROR_EVENT) | spot, F.col("time")),
        }
    )
    return e.withColumns({"known_key": _key("known_name"), "name_key": _key("name"), "parent_key": _key("parent_id")}).drop("known_name")


def _first(value: str, where: str = "true") -> Column:
    return F.expr(f"min_by({value}, seq) FILTER (WHERE {value} IS NOT NULL AND {where})")


def _summed(e: DataFrame, with_paths: bool = True) -> DataFrame:
    """One row per task of what can be summed up in any order.

    All of it has a fixed width, so that Spark aggregates by hash and sorts nothing: of names, ids and paths it takes the
    ``seq`` of the event that decides, and hashes that tell whether two of them differ. ``_details`` fetches the values."""
    is_ = lambda kind: f"type = '{kind}'"
    seq_of = lambda where: F.expr(f"min(seq) FILTER (WHERE {where})")
    aggs = [
        F.min("seq").alias("first_seq"), F.min_by("known_key", "seq").alias("name_key"), seq_of("parent_id IS NOT NULL").alias("parent_seq"),
        _first("parent_key").alias("parent_key"), F.min("parent_key").alias("parent_lo"), F.max("parent_key").alias("parent_hi"),
        _first("begin").alias("begin"), _first("end").alias("end"), F.min_by("time", "seq").alias("first_time"),
        F.expr("min(time) FILTER (WHERE type = 'StartEvent')").alias("start_lo"), F.expr("max(time) FILTER (WHERE type = 'StartEvent')").alias("start_hi"),
        F.expr("min(time) FILTER (WHERE type = 'SuccessEvent')").alias("success_lo"), F.expr("max(time) FILTER (WHERE type = 'SuccessEvent')").alias("success_hi"),
        F.expr("min(time) FILTER (WHERE type = 'ErrorEvent')").alias("error_lo"), F.expr("max(time) FILTER (WHERE type = 'ErrorEvent')").alias("error_hi"),
        *[F.expr(f"count_if({is_(k)})").alias(n) for k, n in ((M.START, "starts"), (M.SUCCESS_EVENT, "successes"), (M.ERROR_EVENT, "errors"), (M.SPOT, "spots"))],
        *[seq_of(is_(k)).alias(n) for k, n in ((M.START, "start_seq"), (M.SUCCESS_EVENT, "success_seq"), (M.ERROR_EVENT, "error_seq"))],
        F.expr(f"max(seq) FILTER (WHERE {is_(M.SPOT)})").alias("spot_seq"), F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"),
        F.expr("min_by(named_date, seq) FILTER (WHERE is_start)").alias("start_date"), F.max_by("named_date", "seq").alias("last_date"),
    ]
    if with_paths:
        foreign = "primary_id <> task_id"
        key = "xxhash64(primary_id)"
        aggs += [
            F.coalesce(seq_of(foreign), seq_of("primary_id IS NOT NULL")).alias("primary_seq"), F.expr(f"min({key}) FILTER (WHERE {foreign})").alias("primary_lo"), F.expr(f"max({key}) FILTER (WHERE {foreign})").alias("primary_hi"),
            seq_of("parents_path IS NOT NULL").alias("path_seq"), F.min(_key("parents_path")).alias("path_lo"), F.max(_key("parents_path")).alias("path_hi"), F.bool_or("orphan").alias("orphan"),
        ]
    return e.groupBy(*KEY).agg(*aggs)


def _differ(lo: str, hi: str) -> Column:
    return F.coalesce(F.col(lo) != F.col(hi), F.lit(False))


def _same_task(prefix: str) -> Column:
    """Equal keys, nulls too, to a side whose keys have ``prefix``."""
    return F.col("env").eqNullSafe(F.col(f"{prefix}env")) & F.col("task_id").eqNullSafe(F.col(f"{prefix}task_id"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in KEY})


#: What an event may object to, by the place of the reason.
_REASONS = (M.STARTED_TIME, M.STARTED_NAME, M.STARTED_PARENT, M.CLOSED_STATUS, M.CLOSED_TIME)


def _details(e: DataFrame, sums: DataFrame) -> DataFrame:
    """What one more pass over the events gives: ``own_name``, ``parent_id``, ``primary_id`` and ``parents_path`` of each task, taken from the
    events that ``sums`` points at, and of tasks in which an event contradicts an earlier one the ``objection`` and whether parents differ.

    Only events that can decide something are joined, and after the join only those stay that do. A task has four
    decisive events at most, so its list of them is short. As keys are compared null-safe, Spark shuffles once more after partial
    aggregation, which lets it split the partition of a hot task in the join."""
    maybe = (F.col("starts") > 1) | ((F.col("successes") > 0) & (F.col("errors") > 0)) | (F.col("successes") > 1) | (F.col("errors") > 1) | _differ("parent_lo", "parent_hi")
    known = sums.select(*KEY, maybe.alias("maybe"), "first_seq", "parent_seq", "primary_seq", "path_seq", "start_seq", "success_seq", "error_seq", F.col("name_key").alias("t_name"), F.col("parent_key").alias("t_parent"), F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))
    values = {"own_name": ("name", "first_seq"), "parent_id": ("parent_id", "parent_seq"), "primary_id": ("primary_id", "primary_seq"), "parents_path": ("parents_path", "path_seq")}
    may_decide = F.col("type").isin(M.START, M.SUCCESS_EVENT, M.ERROR_EVENT)
    for column, _ in values.values():
        may_decide |= F.col(column).isNotNull()
    j = e.filter(may_decide).select(*KEY, "seq", "type", "time", "name_key", "parent_key", *[c for c, _ in values.values()]).join(kept_apart(_prefixed(known, "k_"), sums), _same_task("k_"))
    decisive = F.lit(False)
    for column, at in values.values():
        decisive |= F.coalesce((F.col("seq") == F.col(at)) & F.col(column).isNotNull(), F.lit(False))
    j = j.filter(F.col("maybe") | decisive)
    # what an event would object to if nothing before it had been objected to
    code = {r: F.lit(i) for i, r in enumerate(_REASONS)}
    parent_now = F.when(F.col("parent_seq") <= F.col("seq"), F.col("t_parent"))
    again = (F.col("type") == M.START) & (F.col("seq") > F.col("start_seq"))
    start_reason = (
        F.when(F.col("time") != F.col("t_begin"), code[M.STARTED_TIME])
        .when(~F.col("name_key").eqNullSafe(F.col("t_name")), code[M.STARTED_NAME])
        .when(parent_now.isNotNull() & ~F.col("parent_key").eqNullSafe(parent_now), code[M.STARTED_PARENT])
    )

    def close(own: str, other: str) -> Column:
        return F.when(F.col(other) < F.col("seq"), code[M.CLOSED_STATUS]).when((F.col(own) < F.col("seq")) & (F.col("time") != F.col("t_end")), code[M.CLOSED_TIME])

    reason = F.when(again, start_reason).when(F.col("type") == M.SUCCESS_EVENT, close("success_seq", "error_seq")).when(F.col("type") == M.ERROR_EVENT, close("error_seq", "success_seq"))
    chosen = F.struct(*[F.when(F.col("seq") == F.col(at), F.col(column)).alias(name) for name, (column, at) in values.items()])
    j = j.select(*KEY, "seq", F.when(F.col("maybe"), reason).alias("reason"), (F.col("parent_key") != F.col("t_parent")).alias("other_parent"), F.when(decisive, chosen).alias("chosen"))
    found = j.groupBy(*KEY).agg(F.expr("min_by(reason, seq) FILTER (WHERE reason IS NOT NULL)").alias("objection"), F.bool_or("other_parent").alias("other_parent"), F.collect_list("chosen").alias("chosen"))
    reasons = F.array(*map(F.lit, _REASONS))
    one = lambda name: F.get(F.filter("chosen", lambda x: x[name].isNotNull()), F.lit(0))[name].alias(name)
    return found.select(*KEY, F.get(reasons, F.col("objection")).alias("objection"), "other_parent", *map(one, values))


def step(status: Column, e: Column, begin: Column, end: Column, name: Column, parent: Column) -> Column:
    """(status, reason) after event ``e`` of a task that has this status, first begin and end, name and parent before it; names and parents may be hashes."""
    ok = lambda s: F.struct(s.alias("status"), F.lit(None).cast("string").alias("reason"))
    bad = lambda r: F.struct(F.lit(M.CORRUPTED).alias("status"), F.lit(r).alias("reason"))
    is_ = lambda *x: status.isin(*x)

    def close(own: str, partial: str, other: str, other_partial: str) -> Column:
        return (
            F.when(is_(M.CORRUPTED), ok(status)).when(is_(M.UNTERMINATED), ok(F.lit(own))).when(is_(other, other_partial), bad(M.CLOSED_STATUS))
            .when(is_(own, partial), F.when(end.isNotNull() & (end != e["time"]), bad(M.CLOSED_TIME)).otherwise(ok(status))).otherwise(ok(F.lit(partial)))
        )

    start = (
        F.when(is_(M.UNTERMINATED, M.SUCCESS, M.ERROR), F.when(begin.isNotNull() & (begin != e["time"]), bad(M.STARTED_TIME)).when(name.isNotNull() & ~name.eqNullSafe(e["name"]), bad(M.STARTED_NAME)).when(parent.isNotNull() & ~parent.eqNullSafe(e["parent_id"]), bad(M.STARTED_PARENT)).otherwise(ok(status)))
        .when(is_(M.PARTIAL_SUCCESS), ok(F.lit(M.SUCCESS))).when(is_(M.PARTIAL_ERROR), ok(F.lit(M.ERROR))).when(is_(M.CORRUPTED), ok(status)).otherwise(ok(F.lit(M.UNTERMINATED)))
    )
    kind = e["type"]
    return (
        F.when(kind == M.START, start).when(kind == M.SUCCESS_EVENT, close(M.SUCCESS, M.PARTIAL_SUCCESS, M.ERROR, M.PARTIAL_ERROR)).when(kind == M.ERROR_EVENT, close(M.ERROR, M.PARTIAL_ERROR, M.SUCCESS, M.PARTIAL_SUCCESS))
        .when(kind == M.SPOT, ok(F.coalesce(e["status"], F.lit(M.CORRUPTED)))).otherwise(ok(F.coalesce(status, F.lit(M.PARTIAL_INFO))))
    )


#: Events after a spot that are walked in one row.
SLICE = 4096


def _after_spots(e: DataFrame, tasks: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Status of tasks with a spot: walked from the last spot on, with the first values known before each event.

    The walk is a small state machine. Events after a spot are sorted by ranges and cut into slices by rank; a slice gives the
    status and reason for every status before it, and a task's slices are chained. So a task with any number of
    events after its spot is walked in many tasks."""
    spotted = tasks.filter("spots > 0").select(*KEY, "spot_seq", F.col("name_key").alias("t_name"), F.col("parent_key").alias("t_parent"), "parent_seq", F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))
    if spotted.isEmpty():
        return spotted.select(*KEY, F.lit(None).cast("string").alias("walked"), F.lit(None).cast("string").alias("walked_reason"))
    spots = e.filter(F.col("type") == M.SPOT).select(*KEY, F.col("seq").alias("spot_seq"), F.coalesce("status", F.lit(M.CORRUPTED)).alias("spot_status"))
    spotted = stored(spotted.join(spots, [*KEY, "spot_seq"]), "spots")
    # the last spot has begun and ended the task before any later event, so these are the stored values
    later = e.join(spotted.drop("spot_status"), KEY).filter("seq > spot_seq").select(*KEY, "seq", F.struct("seq", "type", "time", F.col("name_key").alias("name"), F.col("parent_key").alias("parent_id"), "status", "t_begin", "t_end", "t_name", F.when(F.col("parent_seq") <= F.col("seq"), F.col("t_parent")).alias("t_parent")).alias("e"))
    order = [*KEY, "seq"]
    later = stored(later.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "after-spots")
    slices = later.groupBy(*KEY, F.floor(F.col("place") / slice_rows).alias("slice")).agg(F.array_sort(F.collect_list("e")).alias("later"))
    # statuses that a spot may carry and no rule names behave as the unknown one does, whatever they are called
    others = slices.join(spotted.select(*KEY, "spot_status"), KEY)

    def walk(acc: Column, x: Column) -> Column:
        other = x["parent_id"].isNotNull() & x["t_parent"].isNotNull() & (x["parent_id"] != x["t_parent"])
        before = F.when(other, F.lit(M.CORRUPTED)).otherwise(acc["status"])
        after = step(before, x, x["t_begin"], x["t_end"], x["t_name"], x["t_parent"])
        return F.struct(after["status"].alias("status"), F.coalesce(after["reason"], F.when(other, F.lit(M.DIFFERENT_PARENT)), acc["reason"]).alias("reason"))

    start = lambda s: F.struct(s.alias("status"), F.lit(None).cast("string").alias("reason"))
    starts = F.array_distinct(F.array(*map(F.lit, M.STATUSES), F.col("spot_status")))
    tables = others.select(*KEY, "slice", F.transform(starts, lambda s: F.struct(s.alias("before"), F.aggregate("later", start(s), walk).alias("after"))).alias("ways"))
    chained = tables.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("slice", F.map_from_entries("ways").alias("ways"))), lambda a, b: F.when(a["slice"] < b["slice"], -1).when(a["slice"] > b["slice"], 1).otherwise(0)).alias("slices"))
    rows = spotted.select(*KEY, "spot_status").join(chained, KEY, "left")
    through = lambda acc, x: F.struct(x["ways"][acc["status"]]["status"].alias("status"), F.coalesce(x["ways"][acc["status"]]["reason"], acc["reason"]).alias("reason"))
    walked = F.aggregate(F.coalesce("slices", F.array().cast(rows.schema["slices"].dataType)), start(F.col("spot_status")), through)
    return rows.select(*KEY, walked["status"].alias("walked"), walked["reason"].alias("walked_reason"))


def fold_maps(e: DataFrame) -> DataFrame:
    """The four maps of each task: of a key's values the last one in order, by partial aggregation per key."""
    # numbers travel as text, which gives the same number back, so that one pass over the events does for all maps
    sides = ", ".join(f"'{new}', CAST({old} AS map<string, string>)" for old, new in M.MAPS.items())
    rows = e.select(*KEY, "seq", F.expr(f"stack({len(M.MAPS)}, {sides}) AS (map, entries)")).select(*KEY, "seq", "map", F.explode("entries").alias("key", "value"))
    last = rows.groupBy(*KEY, "map", "key").agg(F.max_by("value", "seq").alias("value"))
    entries = lambda name, kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("map") == name, F.struct("key", F.col("value").cast(kind).alias("value"))))))
    return last.groupBy(*KEY).agg(*[entries(n, "double" if n == "metric" else "string").alias(n) for n in M.MAPS.values()])


def status_of(t: DataFrame | None = None) -> Column:
    """Status from the sums of ``_summed`` for tasks without spots, conflicts with names and parents aside."""
    ended = F.when(F.col("successes") > 0, 1).when(F.col("errors") > 0, 2).otherwise(0)
    clash = ((F.col("successes") > 0) & (F.col("errors") > 0)) | _differ("start_lo", "start_hi") | _differ("success_lo", "success_hi") | _differ("error_lo", "error_hi")
    started = F.col("starts") > 0
    return (
        F.when(clash, M.CORRUPTED)
        .when(started, F.when(ended == 1, M.SUCCESS).when(ended == 2, M.ERROR).otherwise(M.UNTERMINATED))
        .otherwise(F.when(ended == 1, M.PARTIAL_SUCCESS).when(ended == 2, M.PARTIAL_ERROR).otherwise(M.PARTIAL_INFO))
    )


def fold(events: DataFrame, now: Column | None = None, days: int = 90, version: str | None = None, suffix: str = M.ID_SUFFIX, with_maps: bool = True) -> DataFrame:
    """One task (columns of model.TASK) per env and task_id from events in the order of ``seq``, which is unique within a task.

    Order within a task is all that matters; tasks with events in two environments are two tasks. ``now`` is the time
    that retention counts from, ``version`` a string that every task starts with."""
    now = F.current_timestamp() if now is None else now
    e = prepared(events, suffix).withColumn("named_date", N.retention(F.col("date_to_delete"), now, days))
    sums = stored(_summed(e), "fold-sums")
    tasks = sums.join(_prefixed(_details(e, sums), "d_"), _same_task("d_"), "left").join(_after_spots(e, sums), KEY, "left")
    other_primary, other_path = _differ("primary_lo", "primary_hi"), _differ("path_lo", "path_hi")
    plain = F.when(F.coalesce("other_parent", F.lit(False)) | F.col("objection").isNotNull() | other_primary | other_path, F.lit(M.CORRUPTED)).otherwise(status_of())
    status = F.when(other_primary | other_path, M.CORRUPTED).otherwise(F.coalesce("walked", plain))
    reason = F.when(other_path, M.DIFFERENT_PATH).when(other_primary, M.DIFFERENT_PRIMARY).when(F.col("spots") > 0, F.col("walked_reason")).when(F.col("other_parent"), M.DIFFERENT_PARENT).otherwise(F.col("objection"))
    begin = F.coalesce("begin", "first_time")
    done = status.isin(M.SUCCESS, M.ERROR)
    out = tasks.select(
        *KEY, N.name_of(F.col("own_name"), F.col("task_id"), suffix).alias("name"), status.alias("status"), "parent_id", "primary_id", "parents_path", begin.alias("task_begin"), F.col("end").alias("task_end"),
        F.when(done, F.expr("unix_micros(end)").cast("long")).alias("_end"), F.coalesce("start_date", "last_date").alias("date_to_delete"), "orphan", reason.alias("reason"),
    )
    out = out.withColumn("duration", F.expr("(_end - unix_micros(task_begin)) div 1000")).drop("_end")
    if not with_maps:
        return out
    maps = fold_maps(e)
    full = out.join(maps, KEY, "left")
    empty = lambda kind: F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
    full = full.withColumns({n: F.coalesce(n, empty("double" if n == "metric" else "string")) for n in M.MAPS.values()})
    seeds = F.create_map(F.lit("clientVersion"), F.lit(version)) if version else empty("string")
    reasons = F.when(F.col("reason").isNotNull(), F.create_map(F.lit(M.REASON), F.col("reason"))).otherwise(empty("string"))
    full = full.withColumn("string", N.merge_maps(N.merge_maps(seeds, F.col("string")), reasons))
    return full.select(*M.TASK.names)
