"""What is let in: name filter, rate limit, duplicate envelopes, batches by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions.normalize import name_of
from .batches import by_size  # noqa: F401 (it is admission, too)


def keep_named(events: DataFrame, keep_regex: str, enabled: bool = True) -> DataFrame:
    """With ``enabled``, events whose name (or, without one, their id's) begins with "metadata" or matches the whole regex."""
    if not enabled:
        return events
    name = name_of(F.col("name"), F.col("task_id"))
    return events.filter(name.rlike(r"^metadata") | name.rlike(f"^(?:{keep_regex})$"))


def _rated(events: DataFrame, period: str, time: str) -> DataFrame:
    """Events with the name and the period (its start in microseconds) that they count for; without a time they count together."""
    start = F.coalesce(F.unix_micros(F.window(F.coalesce(F.col(time), F.lit("0001-01-01").cast("timestamp")), period)["start"]), F.lit(0))
    return events.withColumns({"_name": F.coalesce(name_of(F.col("name"), F.col("task_id")), F.lit("")), "_period": start})


def rate_limited(events: DataFrame, limit: int, period: str = "1 minute", time: str = "time", spread: int = 64, earlier: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` events in order of each name and period; more are dropped, as is the point of a limit.

    ``earlier`` has the counts (``rate_counts``) of batches before this one, several rows a name and period if need be: with them the
    limit holds across batches, so a log gives the same events however it is cut into batches.

    Within ``spread`` slices of a name and period the slice's first ``limit`` are kept first, so that a hot name is never
    ordered in one task: that task gets ``spread`` times ``limit`` rows at most."""
    e = _rated(events, period, time).withColumn("_slice", F.pmod(F.xxhash64("seq"), F.lit(spread)))
    local = Window.partitionBy("_name", "_period", "_slice").orderBy("seq")
    whole = Window.partitionBy("_name", "_period").orderBy("seq")
    e = e.withColumn("_n", F.row_number().over(local)).filter(F.col("_n") <= limit)
    had = F.lit(0)
    if earlier is not None:
        counts = earlier.groupBy(F.col("name").alias("_name"), F.col("period").alias("_period")).agg(F.sum("n").alias("_had"))
        e, had = e.join(counts, ["_name", "_period"], "left"), F.coalesce("_had", F.lit(0))
    e = e.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") + had <= limit)
    return e.select(*events.columns)


def rate_counts(let_in: DataFrame, period: str = "1 minute", time: str = "time") -> DataFrame:
    """name, period, n: how many events were let in, for ``rate_limited`` of later batches."""
    return _rated(let_in, period, time).groupBy(F.col("_name").alias("name"), F.col("_period").alias("period")).agg(F.count(F.lit(1)).alias("n"))


def once_per_window(envelopes: DataFrame, id_col: str = "id", time: str = "received", seconds: int = 10, order: str | None = None) -> DataFrame:
    """Envelopes whose id was not let in within ``seconds`` before; those without an id all pass.

    An id's first arrival opens a window; the next one let in is the first at or after its end, and opens the next.
    Arrivals with gaps below ``seconds`` are a run, whose first is always let in; only a run's times are walked in order.
    Each id's rows are looked at in order by a window function, so an id must not be hot (ids are unique per envelope)."""
    span = seconds * 1_000_000
    w = Window.partitionBy(id_col).orderBy("_at", *([order] if order else []))
    e = envelopes.filter(F.col(id_col).isNotNull()).withColumn("_at", F.unix_micros(F.col(time)))
    e = e.withColumn("_gap", F.col("_at") - F.lag("_at").over(w))
    e = e.filter("_gap IS NULL OR _gap > 0")  # of one time only the first
    runs = e.withColumn("_run", F.sum(F.when(F.col("_gap") < span, 0).otherwise(1)).over(Window.partitionBy(id_col).orderBy("_at")))
    times = runs.groupBy(F.col(id_col).alias("_id"), "_run").agg(F.array_sort(F.collect_list("_at")).alias("_times"))
    walk = lambda acc, x: F.when((F.size(acc) > 0) & (x - F.get(acc, F.size(acc) - 1) < span), acc).otherwise(F.concat(acc, F.array(x)))
    kept = times.select("_id", F.explode(F.aggregate("_times", F.array().cast("array<bigint>"), walk)).alias("_kept"))
    one = e.join(kept, (F.col(id_col) == F.col("_id")) & (F.col("_at") == F.col("_kept")), "left_semi").select(*envelopes.columns)
    return envelopes.filter(F.col(id_col).isNull()).unionByName(one)


def heartbeats(events: DataFrame, name: str = M.HEARTBEAT) -> tuple[DataFrame, DataFrame]:
    """(client heartbeats, equal ones once; other events)."""
    is_beat = F.coalesce(F.col("name") == name, F.lit(False))
    beats = events.filter(is_beat).select("time", "env", F.to_json("metrics").alias("metrics"), F.to_json("strings").alias("strings")).distinct()
    return beats, events.filter(~is_beat)
