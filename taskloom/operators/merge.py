"""Merging folded tasks into stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions.normalize import merge_maps

KEY = ["env", "task_id"]
#: The fields by which parts decide what becomes of a task's status, times and date.
DECIDES = ["status", "task_begin", "task_end"]
#: The four cells in which a task delivered again as a whole completes a stored part of it, if ``monotone``.
COMPLETIONS = ((M.UNTERMINATED, M.SUCCESS), (M.UNTERMINATED, M.ERROR), (M.PARTIAL_SUCCESS, M.SUCCESS), (M.PARTIAL_ERROR, M.ERROR))


def merged_status(old: Column, new: Column, old_begin: Column, new_begin: Column, old_end: Column, new_end: Column, monotone: bool = False) -> Column:
    """struct(status, begin, end, duration, reason, ended) of a stored task after a new part; ``ended`` if duration is set here.

    ``monotone``: a whole task completes a stored part of it where times agree; else the part stays as it was."""

    def out(status, begin=old_begin, end=old_end, timed=False, reason=None):
        ms = F.unix_millis(end) - F.unix_millis(begin) if timed else F.lit(None).cast("long")
        return F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), begin.alias("begin"), end.alias("end"), ms.alias("duration"), F.lit(reason).cast("string").alias("reason"), F.lit(timed).alias("ended"))

    bad = lambda r: out(M.CORRUPTED, reason=r)
    same = out(old)
    begins = lambda then: F.when(~old_begin.eqNullSafe(new_begin), bad(M.STARTED_TIME)).otherwise(then)
    ends = lambda then: F.when(~old_end.eqNullSafe(new_end), bad(M.CLOSED_TIME)).otherwise(then)
    is_ = lambda *s: new.isin(*s)

    def closed(own: str, partial: str, other: str, other_partial: str) -> Column:
        return F.when(is_(own), ends(begins(same))).when(is_(other, other_partial), bad(M.CLOSED_STATUS)).when(is_(M.UNTERMINATED), begins(same)).when(is_(partial), ends(same)).otherwise(same)

    def partly(own: str, partial: str, other: str, other_partial: str) -> Column:
        whole = out(own, begin=new_begin, timed=True) if monotone else same
        return F.when(is_(own), ends(whole)).when(is_(partial), ends(same)).when(is_(other, other_partial), bad(M.CLOSED_STATUS)).when(is_(M.UNTERMINATED), out(own, begin=new_begin, timed=True)).otherwise(same)

    started = F.when(is_(M.UNTERMINATED), begins(same))
    for whole, partial in ((M.SUCCESS, M.PARTIAL_SUCCESS), (M.ERROR, M.PARTIAL_ERROR)):
        started = started.when(is_(whole), begins(out(whole, end=new_end, timed=True) if monotone else same)).when(is_(partial), out(whole, end=new_end, timed=True))
    informed = F.when(is_(M.SUCCESS, M.ERROR), out(new, new_begin, new_end, True)).when(is_(M.UNTERMINATED), out(new, begin=new_begin)).when(is_(M.PARTIAL_SUCCESS, M.PARTIAL_ERROR), out(new, end=new_end)).otherwise(same)
    return (
        F.when(new.isNull(), same)
        .when(is_(M.CORRUPTED), out(M.CORRUPTED))
        .when(old == M.SUCCESS, closed(M.SUCCESS, M.PARTIAL_SUCCESS, M.ERROR, M.PARTIAL_ERROR))
        .when(old == M.ERROR, closed(M.ERROR, M.PARTIAL_ERROR, M.SUCCESS, M.PARTIAL_SUCCESS))
        .when(old == M.UNTERMINATED, started.otherwise(same))
        .when(old == M.PARTIAL_SUCCESS, partly(M.SUCCESS, M.PARTIAL_SUCCESS, M.ERROR, M.PARTIAL_ERROR))
        .when(old == M.PARTIAL_ERROR, partly(M.ERROR, M.PARTIAL_ERROR, M.SUCCESS, M.PARTIAL_SUCCESS))
        .when(old == M.PARTIAL_INFO, informed)
        .otherwise(out(M.CORRUPTED))
    )


def _united(name: str, o: Callable[[str], Column], n: Callable[[str], Column], s: Column) -> Column:
    """Field ``name`` of a stored task (fields by ``o``) with a new part of it (fields by ``n``) merged in; ``s`` is merged_status.

    Retention moves only while the stored task is a part; maps unite, the new value winning; other fields take the new
    value unless it is null."""
    if name == "status":
        return s["status"]
    if name in ("task_begin", "task_end"):
        return s[name.partition("_")[2]]
    if name == "duration":
        return F.when(s["ended"], s["duration"]).otherwise(o(name))
    if name == "date_to_delete":
        return F.when(~o("status").isin(M.SUCCESS, M.UNTERMINATED, M.ERROR), F.coalesce(n(name), o(name))).otherwise(o(name))
    if name in ("ctx", "text", "metric"):
        return merge_maps(o(name), n(name))
    if name == "string":
        # the reason is noted before the incoming strings are put in, which may overwrite it
        noted = F.when(s["reason"].isNotNull(), merge_maps(o(name), F.create_map(F.lit(M.REASON), s["reason"]))).otherwise(o(name))
        return merge_maps(noted, n(name))
    return F.coalesce(n(name), o(name))


def _status(o: Callable[[str], Column], n: Callable[[str], Column], monotone: bool) -> Column:
    return merged_status(o("status"), n("status"), o("task_begin"), n("task_begin"), o("task_end"), n("task_end"), monotone)


def upserted(old: DataFrame, new: DataFrame, monotone: bool = False, key: list[str] | None = None) -> DataFrame:
    """Stored tasks with new ones merged in: one row per key, columns of ``old``.

    Keys are unique on either side. A task only on one side stays as it is; others are merged (``_united``)."""
    key = key or KEY
    o, n = old.select(*[F.col(c).alias(c if c in key else f"o_{c}") for c in old.columns], F.lit(True).alias("o_")), new.select(*[F.col(c).alias(c if c in key else f"n_{c}") for c in new.columns], F.lit(True).alias("n_"))
    j = o.join(n, key, "full_outer")
    of, nf = lambda name: F.col(f"o_{name}"), lambda name: F.col(f"n_{name}")
    j = j.withColumn("s", _status(of, nf, monotone))
    cols = []
    for name in old.columns:
        if name in key:
            cols.append(F.col(name))
        elif name in new.columns:
            cols.append(F.when(F.col("o_").isNull(), nf(name)).when(F.col("n_").isNull(), of(name)).otherwise(_united(name, of, nf, F.col("s"))).alias(name))
        else:
            cols.append(of(name).alias(name))
    return j.select(*cols)


def merged_parts(parts: DataFrame, order: str, columns: list[str], monotone: bool = False) -> DataFrame:
    """One row per task from its parts in the order of column ``order``, merged one after the other; ``columns`` besides the
    key and those of the merge keep the value of the first part.

    A task has a part per batch that it comes in, so its list is short between two compactions."""
    fields = [c for c in columns if c not in KEY]
    one = F.struct(order, *fields)
    grouped = parts.groupBy(*KEY).agg(F.collect_list(one).alias("_parts"))
    kinds = {f.name: f.dataType for f in parts.schema}

    def step(old: Column, new: Column) -> Column:
        of, nf = lambda name: old[name], lambda name: new[name]
        timed = F.transform(F.array(_status(of, nf, monotone)), lambda s: F.struct(*[(_united(c, of, nf, s) if c in M.TASK.names else old[c]).cast(kinds[c]).alias(c) for c in [order, *fields]]))
        return F.get(timed, F.lit(0))

    # maps cannot be ordered, so the parts are sorted by their place alone; a part travels once, the first one as well
    in_order = F.array_sort("_parts", lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))
    first = F.get(in_order, F.lit(0))
    merged = F.when(F.size("_parts") == 1, F.get("_parts", F.lit(0))).otherwise(F.aggregate(F.filter(in_order, lambda x: x[order] != first[order]), first, step))
    return grouped.withColumn("_m", merged).select(*[F.col(c) if c in KEY else F.col("_m")[c].alias(c) for c in columns])
