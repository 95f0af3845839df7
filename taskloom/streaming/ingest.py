"""Events from files to the task store, as a stream or batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions.normalize import normalize
from ..operators import admission, fold, hierarchy, plugins, telemetry
from ..sources import files
from ..sources.store import TaskStore
from .state import Recent, hour_of


@dataclass
class Settings:
    keep_regex: str | None = None
    limit: int | None = None
    period: str = "1 minute"
    days: int = 90
    version: str | None = None
    suffix: str = M.ID_SUFFIX
    rules: list = field(default_factory=list)
    #: What of client heartbeats is summed up, and over which periods of their own time.
    beat_metrics: list[str] = field(default_factory=lambda: ["submitAmount", "avgSubmitDuration", "maxSubmitDuration"])
    beat_period: str = "1 minute"
    #: Hours of file time over which a stream remembers envelope ids and counts of the limit.
    remembers: int = 24 * 90
    #: When new tasks go to the next generation: more rows, bytes or days than this in the newest one.
    most_rows: int | None = None
    most_bytes: int | None = None
    most_days: float | None = None


def admitted(events: DataFrame, settings: Settings, limited: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events to be folded, heartbeats) of a batch of raw events. ``limited`` stands in for the limit within the batch."""
    beats, events = admission.heartbeats(normalize(events, settings.suffix))
    if settings.keep_regex is not None:
        events = admission.keep_named(events, settings.keep_regex)
    if settings.limit is not None:
        events = (limited or (lambda e: admission.rate_limited(e, settings.limit, settings.period)))(events)
    return events, beats


def fold_batch(events: DataFrame, settings: Settings, now: Column, limited: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(tasks, heartbeats, plugin reports) of a batch of raw events, as ``admitted``."""
    events, beats = admitted(events, settings, limited)
    events, reports = plugins.run_all(events, settings.rules, proven=True)
    return fold.fold(events, now, settings.days, settings.version, settings.suffix), beats, reports


def below(waiting: DataFrame, started: DataFrame) -> DataFrame:
    """``node`` of the waiting tasks (with ``node`` and ``up``) below a started one (``node``, stored): level by level, and only by what the last level brought.

    Others keep waiting, whatever the batch has; a level costs a join of the ids that still wait with the new ones."""
    reached, fresh, of = [], started, started
    left = waiting.filter("up IS NOT NULL").select("node", "up")
    out = left.select("node").filter("false")
    while not left.isEmpty():
        new = fresh.select(F.col("node").alias("up"), F.lit(True).alias("met")).distinct()
        met = of = files.stored(left.join(files.kept_apart(new, of), "up", "left"), "below")
        left, fresh = met.filter("met IS NULL").select("node", "up"), met.filter("met")
        if fresh.isEmpty():
            break
        reached.append(fresh.select("node"))
    for hit in reached:
        out = out.unionByName(hit)
    return out


def enriched(tasks: DataFrame, waiting: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tasks of a batch, and stored orphans that it adopts, with roots, paths, inherited context and the orphan flag.

    ``waiting`` are the stored orphans; ``lookup`` gives the stored tasks with some ids (env, task_id).

    Everything goes by environment and id: equal ids in two environments are two trees. Of the stored tasks only orphans below the batch's tasks and
    the parents that are asked for take part; a stored parent that is no orphan brings its whole path, so the tree
    never has to be walked above it. Who takes part is found by ids alone; what else a task has travels once to them and twice through the tree."""
    ids = {"node": hierarchy.scoped("task_id"), "up": hierarchy.scoped("parent_id")}
    tasks = tasks.withColumns(ids)
    is_started = F.col("status").isin(M.UNTERMINATED, M.SUCCESS, M.ERROR, M.CORRUPTED)
    waiting = waiting.filter(F.col("status").isin(M.UNTERMINATED, M.SUCCESS, M.ERROR)).withColumns(ids).select("node", "up", "name", "ctx", F.col("orphan").alias("was"))
    # a waiting task that the batch starts is the batch's; of one that the batch brings a part of, the part takes what is inherited
    here = tasks.select("node", F.coalesce(is_started, F.lit(False)).alias("anew"), F.lit(True).alias("mine"))
    started = files.stored(tasks.filter(is_started).select("node"), "batch-started")
    chosen = below(waiting, started).join(here, "node", "left").filter("NOT coalesce(anew, false)").select("node", F.coalesce("mine", F.lit(False)).alias("mine"))
    old = waiting.join(chosen, "node")
    new = tasks.filter(is_started).select("node", "up", "name", "ctx", F.lit(None).cast("boolean").alias("was"), F.lit(True).alias("mine"))
    nodes = files.stored(new.unionByName(old.select(*new.columns)).withColumnsRenamed({"node": "task_id", "up": "parent_id"}), "batch-nodes")
    # stored parents that have a root stand in as roots of their own and lend what they know
    asked = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("node")).distinct().join(files.kept_apart(nodes.select(F.col("task_id").alias("node")), nodes), "node", "left_anti")
    asked = files.stored(asked.select(F.col("node.env").alias("env"), F.col("node.id").alias("task_id")), "batch-asked")
    known = lookup(asked).filter("NOT coalesce(orphan, false)")
    lend = files.stored(known.withColumns(ids).select(F.col("node").alias("task_id"), "name", "ctx", "primary_id", "parents_path"), "batch-parents")
    lent = {"parent_id": F.lit(None).cast(nodes.schema["parent_id"].dataType), "was": F.lit(None).cast("boolean"), "mine": F.lit(None).cast("boolean")}
    tree = hierarchy.resolve(nodes.unionByName(lend.select("task_id", "name", "ctx").withColumns(lent).select(*nodes.columns)), carried=("was", "mine")).filter("mine IS NOT NULL")
    top = lend.select(F.col("task_id").alias("primary_id"), F.col("primary_id").alias("root2"), F.col("parents_path").alias("path2"), F.lit(True).alias("lent"))
    tree = tree.join(top, "primary_id", "left")
    path = F.when(F.col("lent"), F.concat(F.coalesce("path2", F.array().cast("array<string>")), "parents_path")).otherwise(F.col("parents_path"))
    tree = tree.select(
        F.col("task_id").alias("node"), F.col("parent_id").alias("t_up"), "mine", "was", F.when(F.col("lent"), F.coalesce("root2", "primary_id.id")).otherwise(F.col("primary_id.id")).alias("t_primary"), path.alias("t_path"), F.col("ctx").alias("t_ctx"), F.when(F.col("orphan"), True).when(F.col("was"), False).alias("t_orphan")
    )
    tree = files.stored(tree, "batch-tree")
    joined = tasks.join(files.kept_apart(tree.filter("mine").drop("mine", "was", "t_up"), tree), "node", "left")
    out = joined.withColumns({"primary_id": F.coalesce("t_primary", "primary_id"), "parents_path": F.coalesce("t_path", "parents_path"), "ctx": F.coalesce("t_ctx", "ctx"), "orphan": F.coalesce("t_orphan", "orphan")}).select(*M.TASK.names)
    # an adopted task only brings what it inherits: as a part without news it leaves status, times and names alone
    brings = {"env": F.col("node.env"), "task_id": F.col("node.id"), "parent_id": F.col("t_up.id"), "primary_id": F.col("t_primary"), "parents_path": F.col("t_path"), "orphan": F.lit(False), "ctx": F.col("t_ctx")}
    inherits = tree.filter("NOT mine AND NOT t_orphan").select(*[brings.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.TASK])
    return out.unionByName(inherits)


def limit_across(events: DataFrame, settings: Settings, counts: Recent, number: int, hour: int) -> DataFrame:
    """The events of micro-batch ``number`` that a limit lets in which holds over all micro-batches; ``hour`` of file time is when they came."""
    kept = files.stored(admission.rate_limited(events, settings.limit, settings.period, earlier=counts.before(number)), "limited")
    counts.put(admission.rate_counts(kept, settings.period), F.lit(hour), number)
    return kept


def ingest_batch(
    store: TaskStore, events: DataFrame, settings: Settings | None = None, now: Column | None = None, version: int | None = None, batch: int | None = None, reports: str | None = None, limited: Callable[[DataFrame], DataFrame] | None = None
) -> int:
    """Fold, enrich and append one batch; returns the store's version. The newest version given again replaces that batch.

    After it, the next generation begins if the newest one is over one of the bounds in ``settings``. What is stored on the way is deleted.

    With ``reports``, its heartbeats, the plugins' reports and a row about the batch are written below that folder, by version."""
    settings, spark = settings or Settings(), events.sparkSession
    began = time.time()
    with files.scratch(spark):
        tasks, beats, notes = fold_batch(events, settings, F.current_timestamp() if now is None else now, limited)
        tasks = files.stored(tasks, "batch-tasks")
        before = None if version is None else version - 1
        version = store.append(files.stored(enriched(tasks, store.orphans(before), lambda ids: store.tasks(before, ids)), "batch-enriched"), version, batch)
        if reports is not None:
            beats = files.stored(beats, "batch-beats")
            beats.write.mode("overwrite").json(f"{reports}/heartbeats/version={version}")
            # sums by version, so a batch given again takes its own place and late beats count; ``heartbeats_of`` adds them up
            telemetry.heartbeat_sums(beats, settings.beat_metrics, settings.beat_period).write.mode("overwrite").parquet(f"{reports}/heartbeat_sums/version={version}")
            if notes:
                spark.createDataFrame(notes, plugins.REPORT).coalesce(1).write.mode("overwrite").json(f"{reports}/plugins/version={version}")
            about = telemetry.batch_report(events.withColumn("version", F.lit(version)), "version").drop("version").withColumn("took_ms", F.lit(int((time.time() - began) * 1000)))
            about.write.mode("overwrite").json(f"{reports}/batches/version={version}")
        store.roll_over_if(settings.most_rows, settings.most_bytes, settings.most_days)
    return version


def heartbeats_of(spark: SparkSession, reports: str) -> DataFrame:
    """env, period_start, metric, amount, avg_value, max_value of all heartbeats that came to ``reports``, late ones as well."""
    parts = spark.read.schema("env string, period_start timestamp, metric string, amount long, sum double, max double").parquet(f"{reports.rstrip('/')}/heartbeat_sums/version=*")
    return telemetry.merged_sums(parts)


def numbered(batch: DataFrame) -> DataFrame:
    """``place`` in the order of arrival, without gaps: files by time and name, and lines by their place in the file.

    It is the count of lines in the splits before and the rank within the split; the window only sees one row per split."""
    split = ["received", "file", "block"]
    sizes = batch.groupBy(*split).agg(F.min("place").alias("first"), (F.max("place") - F.min("place") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*split, (before - F.col("first")).alias("shift"))
    return batch.join(F.broadcast(starts), split).withColumn("place", F.col("place") + F.col("shift")).drop("shift")


def let_in(good: DataFrame, earlier: DataFrame, seconds: int = 10) -> DataFrame:
    """Envelopes (id, received, place) without the duplicates; those without an id all pass.

    In order of time, an envelope is a duplicate if one with its id was let in less than ``seconds`` before, and also if
    a micro-batch before this one (``earlier``) let one in less than ``seconds`` after. An id has as many times as the
    batch has files, however often it comes, so its walk is short.

    Only ids that come twice or came before can have duplicates. Those are looked into by id, time and place alone, and the envelopes
    themselves are only shuffled if one of them is dropped."""
    span = seconds * 1_000_000
    named = good.filter("id IS NOT NULL").select("id", F.unix_micros("received").alias("at"), "place")
    seen = named.select("id", F.lit(1).alias("here"), F.lit(0).alias("before")).unionByName(earlier.filter("id IS NOT NULL").select("id", F.lit(0).alias("here"), F.lit(1).alias("before")))
    doubtful = files.stored(seen.groupBy("id").agg(F.sum("here").alias("here"), F.max("before").alias("before")).filter("here > 1 OR here = 1 AND before = 1").select("id"), "micro-batch-doubtful")
    if doubtful.isEmpty():
        return good
    asked = files.kept_apart(doubtful, doubtful)
    named = named.join(asked, "id", "left_semi")
    times = named.groupBy("id", "at").agg(F.min("place").alias("place"))
    had = earlier.join(asked, "id", "left_semi").groupBy("id").agg(F.collect_set(F.unix_micros("received")).alias("had"))
    each = times.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "place"))).alias("times")).join(had.hint("merge"), "id", "left")
    new = F.filter("times", lambda x: ~F.exists(F.coalesce("had", F.array().cast("array<bigint>")), lambda a: F.abs(a - x["at"]) < span))
    kept = F.aggregate(
        "new", F.array().cast("array<struct<at:bigint,place:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["at"] - F.get(acc, F.size(acc) - 1)["at"] < span), acc).otherwise(F.concat(acc, F.array(x))),
    )
    places = each.withColumn("new", new).select(F.explode(F.transform(kept, lambda x: x["place"])).alias("place"))
    dropped = files.stored(named.select("place").join(places.hint("merge"), "place", "left_anti"), "micro-batch-dropped")
    return good if dropped.isEmpty() else good.join(dropped.hint("merge"), "place", "left_anti").select(*good.columns)


#: A malformed line: ``malformed`` is the line as it came last, ``file`` where it first stood, ``letter`` its own id, ``attempts`` how often it was read.
LETTER = "line string, malformed string, file string, reason string, attempts int, letter string, origin string, first_received timestamp"
#: What comes along with a line that is sent again.
_AGAIN = [("attempts", "int"), ("letter", "string"), ("origin", "string"), ("first_received", "timestamp")]
#: How often a line is read at most.
MOST_ATTEMPTS = 3


def _again(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/again"


def _letters(bad: DataFrame, number: int) -> DataFrame:
    """Letters of micro-batch ``number``; given again, it gives the same letters."""
    reason = F.when(F.length(F.trim("malformed")) == 0, "empty").when(~F.trim("malformed").rlike(r"^[\[{]"), "no object").otherwise("no envelope")
    own = F.concat(F.lit(f"letter-{number}-"), F.col("place").cast("string"))
    origin = F.coalesce("origin", "file")
    return bad.select(
        "malformed", origin.alias("file"), reason.alias("reason"), (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempts"), F.coalesce("letter", own).alias("letter"), origin.alias("origin"), F.date_format("received", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("first_received")
    )


def send_again(spark: SparkSession, dead: str, checkpoint: str, mend: Callable[[Column], Column] | None = None, most: int = MOST_ATTEMPTS) -> list[int]:
    """Send the stream's letters in ``dead`` again that were read fewer than ``most`` times; the micro-batches whose letters were sent.

    ``mend`` makes a new line of an old one (a line that a new parser reads needs none). The stream with this ``checkpoint`` reads them with its next
    micro-batches: those that are mended come in once, also if this is broken off and called again; others are letters anew with one more attempt.
    Letters that were read ``most`` times stay where they are and are not sent. Each micro-batch's letters are sent once; a call finds what is
    new by listing folders."""
    again, line = _again(checkpoint), F.col("malformed")
    sent = files.numbers_of(spark, again, "batch")
    out = []
    for number in sorted(files.numbers_of(spark, dead, "batch") - sent):
        letters = spark.read.schema(LETTER).json(f"{dead.rstrip('/')}/batch={number}").filter(F.col("attempts") < most)
        if letters.isEmpty():
            files.make_folder(spark, f"{again}/batch={number}/_SUCCESS")  # done with, and nothing for the stream to read
            continue
        out.append(number)
        letters = letters.withColumn("line", line if mend is None else mend(line))
        letters.select("line", *[c for c, _ in _AGAIN[:3]], F.date_format("first_received", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("first_received")).write.mode("overwrite").json(f"{again}/batch={number}")
    return out


def stream(spark: SparkSession, source: str, store: TaskStore, checkpoint: str, settings: Settings | None = None, dead: str | None = None, once: bool = True, files_per_batch: int = 100, max_age: str = "36500d", reports: str | None = None, parts: int = 64):
    """A query that reads envelope files below ``source`` and merges each micro-batch into ``store``.

    Envelopes with an id let in within ten seconds of file time are dropped, also when the files come out of order; all
    others get through. The ids let in, and the counts of a limit, are tables in ``checkpoint`` that span ``settings.remembers`` hours
    of file time: an envelope with an id whose file is older than that cannot be judged any more and goes to ``checkpoint``/late as it came.
    Malformed lines all go to ``dead``, each as a letter with its reason, origin and number of attempts; what ``send_again`` makes of them is a
    second source of the same stream (a stream begun without ``dead`` cannot be given one later). The store knows which micro-batch it merged last, so one that is replayed after a failure is merged once.
    After more than ``parts`` batches the generations that they touched are written anew.
    Spark itself passes over files that are older than the newest one by more than ``max_age``."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", max_age).load(source)
    where = [F.col("_metadata.file_modification_time").alias("received"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    settings, kept = settings or Settings(), checkpoint.rstrip("/")
    rows = lines.select(F.col("value"), *where, *[F.lit(None).cast(t).alias(c) for c, t in _AGAIN])
    if dead is not None:
        files.make_folder(spark, again := _again(checkpoint))
        letters = spark.readStream.schema(LETTER).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", max_age).json(f"{again}/batch=*")
        rows = rows.unionByName(letters.select(F.col("line").alias("value"), *where, *[F.col(c) for c, _ in _AGAIN]))
    envelopes = files.envelopes_from_text(rows)
    admitted = Recent(spark, f"{kept}/admitted", "id string, received timestamp", settings.remembers)
    counts = Recent(spark, f"{kept}/limits", "name string, period long, n long", settings.remembers)

    def one(batch: DataFrame, number: int) -> None:
        if number <= store.last_batch():
            return
        with files.scratch(spark):
            # a split is read in order by one task, so this grows by one from line to line within it
            batch = numbered(files.stored(batch.withColumn("place", F.monotonically_increasing_id()), "micro-batch"))
            # a letter counts from when its line first came, and one without an id has its own, so that none is let in twice
            batch = batch.withColumns({"received": F.coalesce("first_received", "received"), "id": F.coalesce("id", "letter")})
            if dead is not None:
                _letters(batch.filter("malformed IS NOT NULL"), number).write.mode("overwrite").json(f"{dead}/batch={number}")
            batch = batch.drop(*[c for c, _ in _AGAIN])
            good, hour = batch.filter("malformed IS NULL"), hour_of(F.col("received"))
            if (first := admitted.horizon(number)) is not None:
                late = F.col("id").isNotNull() & (hour < first)
                good.filter(late).select("id", "received", "file", "events").write.mode("overwrite").json(f"{kept}/late/batch={number}")
                good = good.filter(~late)
            good = let_in(good, admitted.before(number))
            # before the merge, and again in the same place if the batch is replayed
            admitted.put(good.filter("id IS NOT NULL"), hour, number)
            newest = batch.agg(F.max(hour)).first()[0] or 0
            # flat, as folding reads the events more than once and each time other fields of them
            events = files.stored(files.events_of(good.withColumnRenamed("place", "seq_base")), "micro-batch-events")
            ingest_batch(store, events, settings, batch=number, reports=reports, limited=lambda e: limit_across(e, settings, counts, number, newest))
            store.tidy(parts)
            for table in (admitted, counts):
                table.expire(number)

    writer = envelopes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
