"""Queues cut into batches by size and time, in parallel within a queue as well.

Where a batch ends follows from where it began, so the cuts of a queue are a chain. Rows are dealt out by ranges of queue and order, and a
range is cut into slices of bounded length. A slice alone can tell, for each of its rows, which batch would still be open at its end if
one began there, and these are few where batches are shorter than slices: the chain only has to be followed from open batch to
open batch, by doubling, and then each slice numbers its own rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import kept_apart, stored

_OWN = ["_queue", "_size", "_at", "_slice", "_n"]
_EXITS = "_slice long, x int, number int, total long, began long"
_LANDED = "_slice long, x int, to long, entry int, to_x int, n int"


def _nexts(size: np.ndarray, at: np.ndarray, most: int, limit: int | None) -> np.ndarray:
    """For a batch that begins at each row, the row where the next one begins; the number of rows if that is none of them."""
    n = len(size)
    sums = np.concatenate([[0], np.cumsum(size)])
    found = np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + most, "right"), np.arange(1, n + 1)), n)
    if limit is not None:
        levels = [at]
        while 2 << (len(levels) - 1) <= n:
            half = 1 << (len(levels) - 1)
            levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
        late = np.arange(1, n + 1)
        for j in range(len(levels) - 1, -1, -1):
            fits = late + (1 << j) <= n
            calm = np.zeros(n, bool)
            calm[fits] = levels[j][late[fits]] <= at[fits] + limit
            late = late + (calm.astype(np.int64) << j)
        found = np.minimum(found, late)
    return found


def _ends(nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a batch that begins at each row: where the one begins that is open at the end, and how many cuts lie between."""
    own = np.arange(len(nexts))
    end, cuts = np.where(nexts < len(nexts), nexts, own), (nexts < len(nexts)).astype(np.int64)
    while not np.array_equal(further := end[end], end):
        cuts, end = cuts + cuts[end], further
    return end, cuts


def _arrays(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    rows = rows.sort_by("_n")
    return rows, rows["_size"].to_numpy(), rows["_at"].to_numpy()


def by_size(events: DataFrame, max_size: int, size: Column, bucket: str, max_seconds: float | None = None, time: str = "time", slice_rows: int = 65_536) -> DataFrame:
    """Events with ``batch`` (from 0) within their queue ``bucket``, in the order of ``seq``, which is unique within a queue.

    Each batch starts empty and takes events until its size exceeds ``max_size`` (so it may do so by one event), or until
    ``max_seconds`` have passed since its first event, as a client does that sends what it has. Times need not grow with ``seq``. A missing
    size is 0, as is a negative one; a missing time is that of the epoch; events without a queue are one.

    No task holds more than ``slice_rows`` rows of a queue at a time. What is looked up between slices is a row for each batch that may be
    open at a slice's end: as many as a batch has rows at most, so slices should be longer than batches. Rows, and open batches, meet what is found about them
    by shuffles: their files are so small for what they hold that Spark would broadcast them in each round."""
    limit = None if max_seconds is None else int(max_seconds * 1_000_000)
    at = F.coalesce(F.unix_micros(time), F.lit(0)) if limit is not None else F.lit(0)
    own = {"_queue": F.to_json(F.struct(F.col(bucket))), "_size": F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).cast("long"), "_at": at.cast("long")}
    sized = events.withColumns(own)
    out = T.StructType([*events.schema, T.StructField("batch", T.LongType())])
    cut = T.StructType([*sized.schema, T.StructField("_slice", T.LongType()), T.StructField("_n", T.IntegerType()), T.StructField("batch", T.LongType())])

    def slices(batches):
        """A slice ends with its queue, or when it is full; ``batch`` counts from its first row on, which is right in a queue's first slice."""
        queue, number, total, began, place = object(), 0, 0, 0, 0
        here = (TaskContext.get().partitionId() << 32) - 1
        for rows in batches:
            found = []
            for q, n, when in zip(rows["_queue"].to_pylist(), rows["_size"].to_pylist(), rows["_at"].to_pylist()):
                if q != queue or place == slice_rows:
                    queue, number, total, began, place, here = q, 0, 0, when, 0, here + 1
                elif total > max_size or (limit is not None and when - began > limit):
                    number, total, began = number + 1, 0, when
                total += n
                found.append((here, place, number))
                place += 1
            s, n, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(b, pa.int64())], [*rows.schema.names, "_slice", "_n", "batch"])

    rows = stored(sized.repartitionByRange("_queue", "seq").sortWithinPartitions("_queue", "seq").mapInArrow(slices, cut), "slices")
    order = Window.partitionBy("_queue").orderBy("_slice")
    about = rows.groupBy("_queue", "_slice").agg(F.sum("_size").alias("total"), F.max("_at").alias("latest"), F.max_by("_size", "_n").alias("last"))
    about = about.withColumns({"i": F.row_number().over(order) - 1, "of": F.count(F.lit(1)).over(Window.partitionBy("_queue"))}).filter("of > 1")
    about = stored(about.select("_queue", "_slice", "i", "of", "total", "latest", (F.col("total") - F.col("last")).alias("inner")), "slices-about")
    most_slices = about.agg(F.max("of")).first()[0]
    if most_slices is None:
        return rows.select(*out.names)

    def exits(key, given):
        given, n, when = _arrays(given)
        end, cuts = _ends(_nexts(n, when, max_size, limit))
        xs = end[:1] if given["i"][0].as_py() == 0 else np.unique(end)
        left = np.cumsum(n[::-1])[::-1]
        return pa.table({"_slice": np.full(len(xs), key[0].as_py()), "x": xs.astype(np.int32), "number": np.full(len(xs), cuts[0], np.int32), "total": left[xs], "began": when[xs]})

    narrow = rows.select(*_OWN).join(about.select("_slice", "i").hint("merge"), "_slice")
    opened = stored(narrow.groupBy("_slice").applyInArrow(exits, _EXITS), "slices-open")
    found = _landing_slices(opened.join(kept_apart(about.select("_slice", "_queue", "i"), about), "_slice"), about, most_slices, max_size, limit)

    def land(key, given, states):
        given, n, when = _arrays(given)
        end, cuts = _ends(_nexts(n, when, max_size, limit))
        k = np.minimum(np.searchsorted(np.concatenate([[0], np.cumsum(n)]), max_size - states["total"].to_numpy(), "right"), len(n))
        if limit is not None:
            k = np.minimum(k, np.searchsorted(np.maximum.accumulate(when), states["began"].to_numpy() + limit, "right"))
        return pa.table({"_slice": states["_slice"], "x": states["x"], "to": np.full(len(k), key[0].as_py()), "entry": k.astype(np.int32), "to_x": end[k].astype(np.int32), "n": (cuts[k] + 1).astype(np.int32)})

    hit = kept_apart(found.select("to").distinct().withColumnRenamed("to", "_slice"), about)
    landed = stored(narrow.join(hit, "_slice", "left_semi").groupBy("_slice").cogroup(found.groupBy("to")).applyInArrow(land, _LANDED), "slices-landed")
    first = about.filter("i = 0").select("_slice")
    met = _followed(opened.join(first, "_slice", "left_semi").select("_slice", "x", F.col("number").cast("long").alias("number")), landed)
    entries = met.join(landed.hint("merge"), ["_slice", "x"]).select(F.col("to").alias("_slice"), "entry", (F.col("number") + 1).alias("number"))
    open_at = about.join(kept_apart(met.select("_slice", F.col("number").alias("open")), about), "_slice", "left")
    before = F.last("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fixes = open_at.select("_slice", "i", before.alias("_open")).filter("i > 0").join(kept_apart(entries, about), "_slice", "left").select("_slice", "_open", F.col("entry").alias("_entry"))

    def number(key, given):
        given, n, when = _arrays(given)
        entry, starts = given["_entry"][0].as_py(), np.zeros(len(n), np.int64)
        if entry is not None:
            nexts = _nexts(n, when, max_size, limit)
            while entry < len(n):
                starts[entry], entry = 1, int(nexts[entry])
        return pa.table({"_slice": given["_slice"], "_n": given["_n"], "batch": given["_open"][0].as_py() + np.cumsum(starts)})

    later = about.filter("i > 0").select("_slice")
    numbers = rows.select(*_OWN).join(fixes.hint("merge"), "_slice").groupBy("_slice").applyInArrow(number, "_slice long, _n int, batch long")
    fixed = rows.drop("batch").join(numbers.hint("merge"), ["_slice", "_n"]).select(*out.names)
    return rows.join(kept_apart(later, about), "_slice", "left_anti").select(*out.names).unionByName(fixed)


def _landing_slices(opened: DataFrame, about: DataFrame, most_slices: int, max_size: int, limit: int | None) -> DataFrame:
    """_slice, x, total, began of open batches, with ``to``, the slice where each ends, and ``total`` up to it; those that never end are left out.

    Blocks of 2^k slices are skipped, the largest first, as long as the batch stays open over all of a block."""
    levels = [about.select("_queue", F.col("i").alias("at"), F.col("total").alias("sum"), "latest", "inner")]
    while 2 << (len(levels) - 1) < most_slices:
        half, a = 1 << (len(levels) - 1), levels[-1]
        b = a.select("_queue", (F.col("at") - half).alias("at"), F.col("sum").alias("sum2"), F.col("latest").alias("latest2"), F.col("inner").alias("inner2"))
        both = a.join(b, ["_queue", "at"])
        levels.append(stored(both.select("_queue", "at", (F.col("sum") + F.col("sum2")).alias("sum"), F.greatest("latest", "latest2").alias("latest"), (F.col("sum") + F.col("inner2")).alias("inner")), "slices-blocks"))
    state = opened.select("_slice", "x", "_queue", (F.col("i") + 1).alias("at"), "total", "began")
    for k in range(len(levels) - 1, -1, -1):
        stays = F.col("total") + F.col("inner") <= max_size
        if limit is not None:
            stays = stays & (F.col("latest") <= F.col("began") + limit)
        stays = F.coalesce(stays, F.lit(False))
        moved = {"at": F.when(stays, F.col("at") + (1 << k)).otherwise(F.col("at")), "total": F.when(stays, F.col("total") + F.col("sum")).otherwise(F.col("total"))}
        state = state.join(levels[k], ["_queue", "at"], "left").withColumns(moved).select("_slice", "x", "_queue", "at", "total", "began")
    ends = about.select("_queue", F.col("i").alias("at"), F.col("_slice").alias("to"))
    return stored(state.join(ends, ["_queue", "at"]).select("_slice", "x", "to", "total", "began"), "slices-ends")


def _followed(met: DataFrame, landed: DataFrame) -> DataFrame:
    """_slice, x, number of the open batches that are met from the first ones (``met``) on, by doubling."""
    jumps = landed.select("_slice", "x", "to", "to_x", F.col("n").cast("long").alias("n"))
    while True:
        new = stored(met.join(jumps.hint("merge"), ["_slice", "x"]).select(F.col("to").alias("_slice"), F.col("to_x").alias("x"), (F.col("number") + F.col("n")).alias("number")), "slices-met")
        if new.isEmpty():
            return met
        met = met.unionByName(new)
        then = jumps.select(F.col("_slice").alias("to"), F.col("x").alias("to_x"), F.col("to").alias("to2"), F.col("to_x").alias("x2"), F.col("n").alias("n2"))
        jumps = stored(jumps.join(then.hint("merge"), ["to", "to_x"]).select("_slice", "x", F.col("to2").alias("to"), F.col("x2").alias("to_x"), (F.col("n") + F.col("n2")).alias("n")), "slices-jumps")
