"""The task table: Parquet folders that only grow, merged when they are read.

A batch appends its tasks as parts below ``parts/version=<n>/generation=<g>``. A task is its parts in the order of their
versions, merged (``merge.merged_parts``). ``compact`` writes a generation anew as ``base/generation=<g>/version=<n>/slot=<s>``, which
stands for all its parts up to then; only generations that need it are rewritten: those with expired tasks, or with many parts.

What a batch reads follows the batch and not the table. Rows carry a hash of (env, task_id) and lie in its order, in small
pages; a slot is the hash's first bits. Some ids are found by their slots (partition pruning) and by their hashes, which
Parquet's column index tells the pages of (``_near``). The tasks that wait for a parent are a table of their own,
``waiting/version=<n>``, which each batch writes anew: it is as large as what waits.

A folder counts once Spark has committed it, so a batch is there as a whole or not at all, and one that is run again under
its version replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..operators import lifecycle, merge
from .files import LARGE, bytes_of, empty, kept_apart, stored

KEY = ["env", "task_id"]
_PART = T.StructType([*M.TASK, T.StructField("batch", T.LongType()), T.StructField("h", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("generation", T.IntegerType()), T.StructField("slot", T.IntegerType())])

#: Ids up to this number are found by their hashes, so many in one scan; more of them by their slots.
MOST_KEYS, KEYS_A_SCAN = 512, 128
#: Tasks that one writer takes when a generation is written anew, roughly; a slot of more is cut by the next bits of the hash.
FILE_ROWS = 1 << 18


def key_hash() -> Column:
    return F.xxhash64(*KEY)


class TaskStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, monotone: bool = False, page_rows: int = 1000):
        """``buckets``: slots of a compacted generation, to the next power of two; ``monotone``: as for ``merge.merged_status``; ``page_rows``:
        rows that are read at least to find one."""
        self.spark, self.path, self.monotone, self.page_rows = spark, path.rstrip("/"), monotone, page_rows
        self.bits = max(0, buckets - 1).bit_length()
        self.buckets = 1 << self.bits

    def _slot(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.bits).cast("int") if self.bits else F.lit(0)

    # the file system is the path's own, whichever it is
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _numbers(self, pattern: str) -> list[tuple[int, ...]]:
        """The numbers in the names of committed folders like parts/version=3 or base/generation=1/version=3."""
        fs, p = self._fs(f"{self.path}/{pattern}/_SUCCESS")
        names = [s.getPath().getParent().toString() for s in fs.globStatus(p) or []]
        return sorted(tuple(int(x.partition("=")[2]) for x in n.split("/")[-pattern.count("/") :] if "=" in x) for n in names)

    def _numbers_below(self, pattern: str) -> list[tuple[int, ...]]:
        """As ``_numbers``, for folders within committed ones."""
        fs, p = self._fs(f"{self.path}/{pattern}")
        names = [s.getPath().toString() for s in fs.globStatus(p) or []]
        return sorted(tuple(int(x.partition("=")[2]) for x in n.split("/")[-pattern.count("/") :] if "=" in x) for n in names)

    def _versions(self) -> list[int]:
        return [v for (v,) in self._numbers("parts/version=*")]

    def _bases(self, version: int | None = None) -> dict[int, int]:
        """Generation -> version of its base."""
        return {g: v for g, v in self._numbers("base/generation=*/version=*") if version is None or v <= version}

    def _next(self) -> int:
        return max([0, *self._versions(), *(v for _, v in self._numbers("base/generation=*/version=*"))]) + 1

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return empty(self.spark, _PART)
        return self.spark.read.schema(_PART).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders])

    def rows(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(compacted tasks, parts since then) as of a version, columns of model.TASK, generation, version, batch."""
        bases = self._bases(version)
        parts = self._read([f"parts/version={v}" for v in self._versions() if version is None or v <= version]).filter("task_id IS NOT NULL")
        for g, v in bases.items():  # a generation spans months
            parts = parts.filter((F.col("generation") != g) | (F.col("version") > v))
        return self._read([f"base/generation={g}/version={v}" for g, v in bases.items()]), parts

    def _near(self, rows: DataFrame, ids: DataFrame, slotted: bool) -> DataFrame:
        """Rows that may have one of the ``ids`` (stored, distinct): those whose pages may hold one, or all of some slots.

        At most ``MOST_KEYS`` hashes or one number a slot come to the driver."""
        hashed = ids.select(key_hash().alias("h")).distinct()
        keys = sorted(r["h"] for r in hashed.limit(MOST_KEYS + 1).collect())
        slot_of = lambda h: (h & ((1 << 64) - 1)) >> (64 - self.bits)
        if len(keys) > MOST_KEYS:
            slots = [r[0] for r in hashed.select(self._slot(F.col("h"))).distinct().collect()] if slotted else []
            return rows.filter(F.col("slot").isin(slots)) if 0 < len(slots) < self.buckets else rows
        out = rows.filter("false")
        for a in range(0, len(keys), KEYS_A_SCAN):
            some = keys[a : a + KEYS_A_SCAN]
            near = rows.filter(F.col("slot").isin(sorted({slot_of(k) for k in some}))) if slotted else rows
            # equalities and not one IN: of an IN the column index only looks at the least and the greatest value
            tests = [F.col("h") == F.lit(k) for k in some]
            while len(tests) > 1:
                tests = [x | y for x, y in zip(tests[::2], tests[1::2])] + tests[len(tests) & ~1 :]
            out = near.filter(tests[0]) if a == 0 else out.unionByName(near.filter(tests[0]))
        return out

    def found(self, ids: DataFrame, version: int | None = None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """``rows`` with one of ``ids`` (env, task_id), by their pages; only the given columns are read."""
        return self._found(stored(ids.select(*KEY).distinct(), "asked"), version, columns)

    def _found(self, ids: DataFrame, version: int | None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        base, parts = self.rows(version)
        # written once, as they are read more than once and the scans are many
        return tuple(stored(self._near(rows, ids, slotted).join(kept_apart(ids, ids), KEY, "left_semi").select(*(columns or rows.columns)), "found") for rows, slotted in ((base, True), (parts, False)))

    def tasks(self, version: int | None = None, ids: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
        """All tasks, or those with one of ``ids`` (env, task_id), with their generation. Tasks without new parts are only read.

        Given ``fields``, which take in ``merge.DECIDES``, no other columns are read and merged."""
        if ids is not None and (ids := stored(ids.select(*KEY).distinct(), "asked")).isEmpty():
            return empty(self.spark, T.StructType([*M.TASK, T.StructField("generation", T.IntegerType())]))
        base, parts = self.rows(version) if ids is None else self._found(ids, version)
        touched = parts.select(*KEY).distinct()
        size = parts.stored_bytes if ids is not None else bytes_of(self.spark, [f"{self.path}/parts/version={v}" for v in self._versions() if version is None or v <= version])
        if size > LARGE:
            touched = touched.hint("merge")
        again = base.join(touched, KEY, "left_semi").unionByName(parts)
        columns = [*(fields or M.TASK.names), "generation"]
        return base.join(touched, KEY, "left_anti").select(*columns).unionByName(merge.merged_parts(again, "version", columns, self.monotone))

    def orphans(self, version: int | None = None) -> DataFrame:
        """Tasks that wait for a parent."""
        kept = [v for (v,) in self._numbers("waiting/version=*") if version is None or v <= version]
        if not kept:
            return empty(self.spark, M.TASK)
        return self.spark.read.schema(M.TASK).parquet(f"{self.path}/waiting/version={kept[-1]}")

    def _wait(self, version: int, again: DataFrame) -> None:
        """Write what waits as of ``version``: what waited before it, tasks with one of ``again`` (env, task_id) as they are now."""
        if again.isEmpty() and not self._numbers(f"waiting/version={version}"):
            return  # the last such table holds
        before = self.orphans(version - 1)
        now = self.tasks(version, again).filter("orphan").select(*M.TASK.names)
        before.join(kept_apart(again, again), KEY, "left_anti").unionByName(now).write.mode("overwrite").parquet(f"{self.path}/waiting/version={version}")

    def generation(self) -> int:
        """The one that new tasks go to."""
        fs, p = self._fs(f"{self.path}/parts/version=*/generation=*")
        found = [int(s.getPath().getName().partition("=")[2]) for s in fs.globStatus(p) or []]
        return max([1, *self._bases(), *found])

    def last_batch(self) -> int:
        """The number of the last micro-batch merged, -1 if none was. Only the newest parts that a micro-batch wrote are read."""
        for v in reversed(self._versions()):
            last = self._read([f"parts/version={v}"]).agg(F.max("batch")).first()[0]
            if last is not None and last >= 0:
                return last
        return -1

    def _write(self, rows: DataFrame, folder: str, by: str) -> None:
        writer = rows.withColumn("h", key_hash()).sortWithinPartitions(by, "h").write.mode("overwrite").option("parquet.page.row.count.limit", self.page_rows)
        writer.partitionBy(by).parquet(f"{self.path}/{folder}")

    def append(self, tasks: DataFrame, version: int | None = None, batch: int | None = None, new: bool = False) -> int:
        """Add parts of tasks; returns the version. A task that is stored stays in its generation, new ones go to the newest.

        A given ``version``, the newest one, is written again in place of itself. ``batch`` is a micro-batch's number. ``tasks`` is looked at more
        than once, so it should be stored. ``new`` says that none of them is stored yet, as in a first load, and none is looked up."""
        version = version or self._next()
        tasks = tasks.select(*M.TASK.names)
        rows = tasks.withColumn("generation", F.lit(None).cast("int"))
        if not new and any(v < version for v in [*self._versions(), *self._bases().values()]):
            base, parts = self.found(tasks, version - 1, [*KEY, "generation", "version"])
            had = base.unionByName(parts).groupBy(*KEY).agg(F.min_by("generation", "version").alias("generation"))
            rows = tasks.join(kept_apart(had, base, parts), KEY, "left")
        rows = rows.withColumns({"generation": F.coalesce("generation", F.lit(self.generation())), "batch": F.lit(-1 if batch is None else batch).cast("long")})
        self._write(rows, f"parts/version={version}", "generation")
        waited = self.orphans(version - 1).select(*KEY)
        again = tasks.filter("orphan").select(*KEY).unionByName(tasks.select(*KEY).join(waited, KEY, "left_semi")).distinct()
        self._wait(version, stored(again, "waiting"))
        return version

    def roll_over(self) -> int:
        """The next generation; tasks that are new from now on go there. A row without an id keeps its number."""
        top = self.generation() + 1
        mark = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in M.TASK], F.lit(top).alias("generation"), F.lit(-1).cast("long").alias("batch"))
        self._write(mark, f"parts/version={self._next()}", "generation")
        return top

    def newest(self) -> dict:
        """rows, bytes and days of the newest generation: from file sizes, Parquet footers and the times of its first and last parts."""
        g = self.generation()
        base = [f"base/generation={g}/version={v}" for gen, v in self._bases().items() if gen == g]
        versions = [v for v, gen in self._numbers_below("parts/version=*/generation=*") if gen == g and v > self._bases().get(g, 0)]
        folders = [*base, *[f"parts/version={v}/generation={g}" for v in versions]]
        if not folders:
            return {"generation": g, "rows": 0, "bytes": 0, "days": 0.0}
        size = sum((fs := self._fs(f"{self.path}/{f}"))[0].getContentSummary(fs[1]).getLength() for f in folders)
        ends = self._read([folders[0], folders[-1]]).agg(F.min("task_begin"), F.max("task_begin")).first()
        return {"generation": g, "rows": self._read(folders).select().count(), "bytes": size, "days": (ends[1] - ends[0]).total_seconds() / 86400 if ends[0] else 0.0}

    def roll_over_if(self, rows: int | None = None, size: int | None = None, days: float | None = None) -> int | None:
        """The next generation, if the newest one is over one of the bounds; it is only looked at if there are some."""
        bounds = {"rows": rows, "bytes": size, "days": days}
        if all(b is None for b in bounds.values()):
            return None
        now = self.newest()
        return self.roll_over() if any(b is not None and now[k] > b for k, b in bounds.items()) else None

    def compact(self, generations: list[int] | None = None, change: Callable[[DataFrame], DataFrame] = lambda t: t) -> int:
        """Write the given generations (all of them, without any) anew as ``change`` leaves them; returns the version."""
        version = self._next()
        now = self.tasks()
        if generations is not None:
            now = now.filter(F.col("generation").isin(generations))
        changed = stored(change(now), "compacted")
        sizes = {r["generation"]: r["count"] for r in changed.groupBy("generation").count().collect()}  # a row per generation
        for g in sorted(generations if generations is not None else {*self._bases(), *(r[0] for r in now.select("generation").distinct().collect())}):
            out = changed.filter(F.col("generation") == g).drop("generation").withColumn("batch", F.lit(-1).cast("long"))
            # a slot's rows are in the order of their hashes, in one file or several
            bits = self.bits + max(0, sizes.get(g, 0) // (FILE_ROWS << self.bits)).bit_length()
            place = F.shiftrightunsigned(key_hash(), 64 - bits).cast("int") if bits else F.lit(0)
            out = out.withColumn("slot", self._slot(key_hash())).repartitionById(1 << bits, place)
            self._write(out, f"base/generation={g}/version={version}", "slot")
        self._wait(version, stored(self.orphans(version - 1).select(*KEY), "waiting"))
        return version

    def pack(self, rows: int, held: set[int] = frozenset()) -> list[list[int]]:
        """Bring neighbouring generations that have ``rows`` tasks together at most into the newest of them; returns the runs that were.

        The newest generation, which is being written, and ``held`` ones stay. Only what is brought together is rewritten."""
        counts = self.tasks().filter(F.col("generation") < self.generation()).groupBy("generation").count()
        runs = [r for r in lifecycle.packed({r["generation"]: r["count"] for r in counts.collect()}, set(held), rows) if len(r) > 1]  # a row per generation
        for run in runs:
            self.compact(run, lambda t, to=run[-1]: t.withColumn("generation", F.lit(to)))
        return runs

    def tidy(self, most: int) -> int | None:
        """When more than ``most`` batches have come since their generations were last written anew, write these anew and delete what they
        replace. So the parts that a batch looks into stay few; a generation is as large as roll-overs let it be."""
        bases = self._bases()
        open_ = {g for v, g in self._numbers_below("parts/version=*/generation=*") if v > bases.get(g, 0)}
        since = [v for v in self._versions() if v > min((bases.get(g, 0) for g in open_), default=0)]
        if len(since) <= most:
            return None
        version = self.compact(sorted(open_))
        self.vacuum()
        return version

    def expire(self, now: Column, top: int | None = None) -> int:
        """Delete expired tasks. Only generations that have some are rewritten, the ``top`` ones with the most if given."""
        found = lifecycle.expired_by_generation(self.tasks(fields=[*KEY, *merge.DECIDES, "date_to_delete"]), now, top or (1 << 20)).collect()  # a row per generation
        return self.compact([r["generation"] for r in found], lambda t: lifecycle.delete_expired(t, now))

    def merge_generations(self, now: Column, monotone: bool = False) -> int:
        """Parts in the newest generation and the one before that belong together are brought together in the newest."""
        top = self.generation()

        def change(t: DataFrame) -> DataFrame:
            current, old = lifecycle.merge_generations(t.filter(F.col("generation") == top), t.filter(F.col("generation") == top - 1), now, monotone)
            return current.unionByName(old)

        return self.compact([top - 1, top], change)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete the folders that reading the last ``keep`` versions does not need, but never the newest parts; returns their versions."""
        versions, bases = self._versions(), self._numbers("base/generation=*/version=*")
        recent = sorted({*versions, *(v for _, v in bases)})[-keep:]
        needed = {(g, v) for r in recent for g, v in self._bases(r).items()}
        oldest = self._bases(recent[0]) if recent else {}
        generations = {r[0] for r in self._read([f"parts/version={v}" for v in versions]).select("generation").distinct().collect()}
        done = min((oldest.get(g, 0) for g in generations), default=0)
        gone = [(f"base/generation={g}/version={v}", v) for g, v in bases if (g, v) not in needed and v < recent[-1]]
        gone += [(f"parts/version={v}", v) for v in versions[:-1] if v <= done]
        waiting = [v for (v,) in self._numbers("waiting/version=*")]
        gone += [(f"waiting/version={v}", v) for v in waiting if recent and v < max((w for w in waiting if w <= recent[0]), default=0)]
        for folder, _ in gone:
            fs, p = self._fs(f"{self.path}/{folder}")
            fs.delete(p, True)
        return sorted({v for _, v in gone})
