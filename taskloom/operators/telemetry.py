"""The engine's own figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored


def heartbeat_windows(events: DataFrame, time: str = "time", value: str = "value", period: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """Per period: events, mean and largest value. Works on streams with a watermark."""
    w = F.window(time, period)
    return events.groupBy(*(by or []), w).agg(F.count(F.lit(1)).alias("amount"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value")).select(*(by or []), F.col("window.start").alias("period_start"), "amount", "avg_value", "max_value")


def heartbeat_sums(beats: DataFrame, metrics: list[str], period: str = "1 minute") -> DataFrame:
    """env, period_start, metric, amount, sum, max of client heartbeats (``metrics`` as JSON): what parts of them add up to.

    A beat without a metric does not count for it."""
    values = F.from_json("metrics", "map<string,double>")
    each = beats.select("env", F.window("time", period)["start"].alias("period_start"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in metrics])).alias("m"))
    each = each.select("env", "period_start", "m.*").filter("value IS NOT NULL")
    return each.groupBy("env", "period_start", "metric").agg(F.count(F.lit(1)).alias("amount"), F.sum("value").alias("sum"), F.max("value").alias("max"))


def merged_sums(sums: DataFrame) -> DataFrame:
    """env, period_start, metric, amount, avg_value, max_value of parts, whenever they came."""
    whole = sums.groupBy("env", "period_start", "metric").agg(F.sum("amount").alias("amount"), F.sum("sum").alias("sum"), F.max("max").alias("max_value"))
    return whole.select("env", "period_start", "metric", "amount", (F.col("sum") / F.col("amount")).alias("avg_value"), "max_value")


def batch_report(events: DataFrame, batch: str) -> DataFrame:
    """Per batch: events, tasks, parents asked for, first and last time, and the time between in ms."""
    return events.groupBy(batch).agg(
        F.count(F.lit(1)).alias("events_amount"), F.countDistinct("task_id").alias("tasks_amount"), F.countDistinct("parent_id").alias("parents_amount"), F.min("time").alias("begin"), F.max("time").alias("end"), (F.unix_millis(F.max("time")) - F.unix_millis(F.min("time"))).alias("duration")
    )


def dead_letters(attempts: DataFrame, hopeless: tuple[str, ...], most: int = 3) -> DataFrame:
    """What still failed on its last try and may be sent again: neither tried ``most`` times nor failed for a hopeless reason.

    ``attempts``: item, attempt, ok, message."""
    last = attempts.groupBy("item").agg(F.max("attempt").alias("attempts"), F.max_by("ok", "attempt").alias("ok"), F.max_by("message", "attempt").alias("message"))
    lost = F.lit(False)
    for text in hopeless:
        lost = lost | F.coalesce(F.contains("message", F.lit(text)), F.lit(False))
    state = F.when(F.col("ok"), "done").when(lost, "dropped").when(F.col("attempts") >= most, "persisted").otherwise("retry")
    return last.select("item", "attempts", state.alias("state"))


def replayed(items: DataFrame, send: Callable[[DataFrame, int], DataFrame], most: int = 3) -> DataFrame:
    """``items`` with attempts and ok after what failed was sent again, at most ``most`` times in all.

    ``send(items, turn)`` adds ``ok``. As long as a turn has a success, the next one takes what is left; each turn's outcome is
    stored, so that nothing is sent twice for it."""
    left, turns = items, []
    for turn in range(1, most + 1):
        sent = stored(send(left, turn).withColumn("attempts", F.lit(turn)), "replayed")
        lost = sent.filter("NOT coalesce(ok, false)")
        turns.append((sent.filter("ok"), lost))
        if turns[-1][0].isEmpty() or lost.isEmpty():
            break
        left = lost.select(*items.columns)
    out = turns[-1][1]
    for good, _ in turns:
        out = out.unionByName(good)
    return out
