"""Queries of the engine's sources, sinks, client and store, with the SQL that gives the same rows.

Logs come from the driver's tables; what is written on the way lies in the shared folder (``files.work_dir``)."""

from __future__ import annotations

import datetime as dt
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import normalize as N
from ..operators import admission, fold, hierarchy, lifecycle, lookup, merge, plugins, telemetry
from ..sources import files
from ..sources.client import MemorySink, Params, StatisticsSink, Tracer
from ..sources.store import TaskStore
from ..streaming import ingest
from ..streaming.state import Recent
from . import logs
from .catalog import DAYS, FOLDED, NOW, S, _now, _tasks, query

# sources and sinks


def _lines(spark, sf_dir) -> DataFrame:
    """A line per order: an envelope, a bare list, broken JSON, or JSON that is no envelope."""
    key = F.col("o_orderkey")
    event = F.to_json(F.struct(F.lit("InfoEvent").alias("@type"), F.concat(F.lit("order___"), key.cast("string")).alias("taskId"), F.lit("2024-01-01T00:00:00Z").alias("time")))
    kind = key % 4
    line = F.when(kind == 0, F.concat(F.lit('{"id":"w'), key.cast("string"), F.lit('","events":['), event, F.lit("]}"))).when(kind == 1, F.concat(F.lit("["), event, F.lit(","), event, F.lit("]"))).when(kind == 2, F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"events":['))).otherwise(F.lit('{"id":"x"}'))
    return logs.table(spark, sf_dir, "orders").select(key.alias("n"), line.alias("value"))


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 4 = 0 THEN concat('w', o_orderkey::VARCHAR) END AS id, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 4 + 1 ELSE 0 END AS events, o_orderkey % 4 >= 2 AS malformed FROM orders")
def malformed_input(spark, sf_dir):
    """Lines that are no envelopes are told apart and lose nothing else."""
    e = files.envelopes_from_text(_lines(spark, sf_dir))
    bad = F.col("malformed").isNotNull()
    return e.select("n", F.when(~bad, F.col("id")).alias("id"), F.when(bad, F.lit(0)).otherwise(F.size("events")).cast("long").alias("events"), bad.alias("malformed"))


@query("SELECT count(*) AS lines, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 4 < 2) AS tasks, sum(CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 4 + 1 ELSE 0 END)::BIGINT AS events FROM orders")
def gzip_landing(spark, sf_dir):
    """Envelope files written with gzip and read as they are."""
    path = files.work_dir(spark, "landing")
    _lines(spark, sf_dir).select("value").write.option("compression", "gzip").text(path)
    e = files.read_envelopes(spark, path).withColumns({"one": F.col("malformed").isNull(), "line": F.monotonically_increasing_id()})
    tasks = F.explode_outer(F.transform(F.when(F.col("one"), F.col("events")), lambda x: x["taskId"])).alias("task")
    rows = e.select("line", tasks)
    return rows.agg(F.countDistinct("line").alias("lines"), F.countDistinct("task").alias("tasks"), F.count("task").alias("events"))


@query("SELECT o_orderkey AS seq, lower(CASE o_orderkey % 3 WHEN 0 THEN 'Prod' WHEN 1 THEN 'qa' ELSE 'default' END) AS env FROM orders WHERE o_orderkey % 5 <> 0")
def clean_ids_and_environments(spark, sf_dir):
    """Events without ids go; environments are in lower case, and one that is missing has the default name."""
    key = F.col("o_orderkey")
    env = F.when(key % 3 == 0, "Prod").when(key % 3 == 1, "qa")
    e = logs.table(spark, sf_dir, "orders").select(*logs._event(seq=key, time=_now(), task_id=F.when(key % 5 != 0, key.cast("string")), type=F.lit(M.INFO), env=env))
    return N.normalize(e).select("seq", "env")


@query("SELECT user_id, event_type, count(DISTINCT (ts, value)) AS beats FROM events WHERE event_id % 3 = 0 GROUP BY user_id, event_type UNION ALL SELECT -1, 'other', count(*) FROM events WHERE event_id % 3 <> 0")
def heartbeat_split(spark, sf_dir):
    """Heartbeats, equal ones once, and what is left of the log. Each one is sent twice."""
    e = logs.table(spark, sf_dir, "events")
    beat = F.col("event_id") % 3 == 0
    e = e.select(*logs._event(seq=F.col("event_id"), time=F.col("ts").cast("timestamp"), task_id=F.col("event_id").cast("string"), type=F.lit(M.SPOT), name=F.when(beat, M.HEARTBEAT).otherwise("task"), env=F.lit("default"), strings=F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")), metrics=F.create_map(F.lit("avgSubmitDuration"), F.col("value"))))
    beats, others = admission.heartbeats(e.unionByName(e.filter(F.col("name") == M.HEARTBEAT)))
    s = F.from_json("strings", "map<string,string>")
    counts = beats.groupBy(s["user"].cast("long").alias("user_id"), s["kind"].alias("event_type")).agg(F.count(F.lit(1)).alias("beats"))
    return counts.unionByName(others.agg(F.lit(-1).cast("long").alias("user_id"), F.lit("other").alias("event_type"), F.count(F.lit(1)).alias("beats")))


# the fold


def _orders_log(spark, sf_dir, **more) -> DataFrame:
    """Two events per order: it starts, and an info or a success follows. ``more`` are columns of events by order and ``k`` (0, 1)."""
    o = logs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    key = F.col("o_orderkey")
    kind = F.when(F.col("k") == 0, M.START).when(key % 2 == 0, M.SUCCESS_EVENT).otherwise(M.INFO)
    cols = {"seq": key * 10 + F.col("k"), "time": F.timestamp_seconds(F.lit(1704067200) + key % 1000 + F.col("k")), "task_id": F.concat(F.lit("order___"), key.cast("string")), "type": kind, "name": F.when(F.col("k") == 0, F.lit("order")), "env": F.lit("default")}
    return o.select(*logs._event(**(cols | more)))


@query(f"""SELECT o_orderkey AS n, CASE o_orderkey % 5 WHEN 0 THEN '{M.DIFFERENT_PRIMARY}' WHEN 1 THEN '{M.DIFFERENT_PATH}' WHEN 2 THEN '{M.DIFFERENT_PARENT}' END AS reason,
  CASE WHEN o_orderkey % 5 < 3 THEN 'CORRUPTED' WHEN o_orderkey % 2 = 0 THEN 'SUCCESS' ELSE 'UNTERMINATED' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 7 IN (1, 2) END AS orphan FROM orders""")
def conflict_flags(spark, sf_dir):
    """Tasks whose events disagree about primary id, path or parent; and the orphan flags of all events put together."""
    key, k = F.col("o_orderkey"), F.col("k").cast("string")
    e = _orders_log(
        spark, sf_dir, primary_id=F.when(key % 5 == 0, F.concat(F.lit("root"), k)), parents_path=F.when(key % 5 == 1, F.array(F.concat(F.lit("p"), k))), parent_id=F.when(key % 5 == 2, F.concat(F.lit("up"), k)),
        orphan=F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, F.lit(True)).when(key % 7 == 2, F.col("k") == 1).otherwise(F.when(F.col("k") == 0, F.lit(False))),
    )
    t = fold.fold(e, _now(), DAYS, with_maps=True)
    return t.select(F.split_part("task_id", F.lit("___"), F.lit(2)).cast("long").alias("n"), F.col("string")[M.REASON].alias("reason"), "status", "orphan")


@query("SELECT o_orderkey AS n, (DATE '2024-02-01' + (o_orderkey % 20)::INT) AS day FROM orders")
def delete_date_pick(spark, sf_dir):
    """The date of the start counts, also where an earlier or a later event has another one."""
    key = F.col("o_orderkey")
    day = F.expr("timestamp'2024-02-01 10:00:00'") + F.make_dt_interval((key % 20).cast("int") + F.when(F.col("k") == 1, 100).otherwise(0))
    first = F.when((key % 2 == 0) & (F.col("k") == 1), -1).otherwise(F.col("k"))  # of even orders the other event comes first
    e = _orders_log(spark, sf_dir, seq=key * 10 + first, date_to_delete=day)
    t = fold.fold(e, _now(), DAYS, with_maps=False)
    return t.select(F.split_part("task_id", F.lit("___"), F.lit(2)).cast("long").alias("n"), F.to_date("date_to_delete").alias("day"))


@query("SELECT event_id AS n, CASE WHEN event_id % 4 = 0 THEN 'CORRUPTED' WHEN event_id % 4 = 1 THEN 'SUCCESS' WHEN event_id % 4 = 2 THEN 'CORRUPTED' ELSE 'ERROR' END AS status FROM events")
def spots_and_later_events(spark, sf_dir):
    """A spot sets the status anew; what comes after it is walked: nothing, a success, an error or an info."""
    key = F.col("event_id")
    e = logs.table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    given = F.when(key % 4 == 3, M.ERROR).when(key % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit(M.SUCCESS))
    kind = F.when(F.col("k") == 0, M.SPOT).when(key % 4 == 1, M.SUCCESS_EVENT).when(key % 4 == 2, M.ERROR_EVENT).otherwise(M.INFO)
    e = e.select(*logs._event(seq=key * 10 + F.col("k"), time=_now(), task_id=F.concat(F.lit("spot___"), key.cast("string")), type=kind, name=F.lit("spot"), status=F.when(F.col("k") == 0, given), env=F.lit("default")))
    return fold.fold(e, _now(), DAYS, with_maps=False).select(F.split_part("task_id", F.lit("___"), F.lit(2)).cast("long").alias("n"), "status")


# trees


@query(f"""WITH RECURSIVE n AS (SELECT env, q.* FROM ({logs.TREE_SQL}) q, (VALUES ('a'), ('b')) v(env) WHERE env = 'a' OR task_id NOT LIKE 'nation%'),
r AS (SELECT env, task_id, task_id AS primary_id, 0::BIGINT AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.env, n.task_id, r.primary_id, r.depth + 1 FROM r JOIN n ON n.parent_id = r.task_id AND n.env = r.env)
SELECT n.env, n.task_id, r.primary_id, r.depth FROM n LEFT JOIN r ON r.env = n.env AND r.task_id = n.task_id""")
def trees_by_environment(spark, sf_dir):
    """Equal ids in two environments are two trees; in one of them all nations are missing."""
    nodes = logs.tree_nodes(spark, sf_dir).withColumn("env", F.explode(F.array(F.lit("a"), F.lit("b")))).filter("env = 'a' OR NOT startswith(task_id, 'nation')")
    t = hierarchy.resolve(nodes.select(hierarchy.scoped("task_id").alias("task_id"), hierarchy.scoped("parent_id").alias("parent_id"), "name", "ctx"))
    return t.select(F.col("task_id.env").alias("env"), F.col("task_id.id").alias("task_id"), F.col("primary_id.id").alias("primary_id"), "depth")


def _as_tasks(nodes: DataFrame) -> DataFrame:
    """Started tasks from nodes of a tree."""
    has = {"env": F.lit("default"), "task_id": F.col("task_id"), "name": F.col("name"), "status": F.lit(M.UNTERMINATED), "parent_id": F.col("parent_id"), "task_begin": _now(), "ctx": F.col("ctx")}
    has |= {c: F.col(c) for c in ("primary_id", "parents_path", "orphan") if c in nodes.columns}
    return nodes.select(*[has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.TASK])


@query(f"""WITH RECURSIVE n AS ({logs.TREE_SQL}),
r AS (SELECT task_id, task_id AS primary_id, ''::VARCHAR AS path, name FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.task_id, r.primary_id, concat(r.path, '>', r.name), n.name FROM r JOIN n ON n.parent_id = r.task_id),
f AS (SELECT task_id FROM n WHERE task_id NOT LIKE 'customer%' AND task_id NOT LIKE 'order%'),
er AS (SELECT task_id FROM f WHERE parent_id IS NULL UNION ALL SELECT f2.task_id FROM er JOIN n f2 ON f2.parent_id = er.task_id WHERE f2.task_id LIKE 'nation%')
SELECT n.task_id, r.primary_id, substr(r.path, 2) AS path, CASE WHEN r.task_id IS NULL THEN true WHEN n.task_id LIKE 'order%' THEN false END AS orphan FROM n LEFT JOIN r ON r.task_id = n.task_id
WHERE n.task_id LIKE 'customer%' OR n.task_id LIKE 'order%' AND r.task_id IS NOT NULL""")
def adopted_with_a_batch(spark, sf_dir):
    """Regions, nations and orphaned orders are stored; customers come as a batch, find their parents there and adopt the orders."""
    nodes = logs.tree_nodes(spark, sf_dir)
    late = F.startswith("task_id", F.lit("customer"))
    first = hierarchy.resolve(nodes.filter(~late))
    known = files.stored(_as_tasks(first), "known")
    out = ingest.enriched(_as_tasks(nodes.filter(late)), known.filter("orphan"), lambda ids: known.join(ids, ["env", "task_id"], "left_semi"))
    return out.select("task_id", "primary_id", F.array_join("parents_path", ">").alias("path"), "orphan")


# the store


@query("""SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN false ELSE true END AS orphan,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 9 END AS day, concat('a', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'b' END) AS names, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS keys FROM orders""")
def merge_fields(spark, sf_dir):
    """A second part of each task: orphan flag, retention (which moves for parts only), name and maps."""
    key = F.col("o_orderkey")
    o = logs.table(spark, sf_dir, "orders").select("o_orderkey")

    def part(second: bool) -> DataFrame:
        whole = key % 2 == 0
        has = {
            "env": F.lit("default"), "task_id": key.cast("string"), "name": F.when(key % 5 != 0, F.lit("ab")) if second else F.lit("a"), "status": F.lit(M.PARTIAL_INFO) if second else F.when(whole, M.UNTERMINATED).otherwise(M.PARTIAL_INFO), "task_begin": _now(),
            "date_to_delete": F.expr(f"timestamp'2024-03-0{9 if second else 1} 00:00:00'"), "orphan": F.when(key % 3 == 1, not second).when(key % 3 == 2, second), "string": F.create_map(F.when(key % 5 == 0, F.lit("k")).otherwise(F.lit("l" if second else "k")), F.lit("2" if second else "1")),
        }
        return o.select(*[has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.TASK])

    t = merge.upserted(part(False), part(True))
    return t.select(F.col("task_id").cast("long").alias("n"), "orphan", F.dayofmonth("date_to_delete").alias("day"), F.col("name").alias("names"), F.size("string").cast("long").alias("keys"))


@query(f"""{FOLDED}, h AS (SELECT task_id, min(seq) % 2 = 0 AS early FROM s WHERE seq % 2 = 0 GROUP BY task_id)
SELECT t.task_id, CASE WHEN h.task_id IS NULL THEN 2 ELSE 1 END AS generation FROM t LEFT JOIN h ON h.task_id = t.task_id""")
def generations_carried(spark, sf_dir):
    """Half of the log, a roll-over, the other half: a task stays in the generation in which it was written first."""
    store = TaskStore(spark, files.work_dir(spark, "tasks"), buckets=4)
    e = logs.session_log(spark, sf_dir)
    store.append(_tasks(spark, sf_dir, True, e.filter("seq % 2 = 0")))
    store.roll_over()
    store.append(_tasks(spark, sf_dir, True, e.filter("seq % 2 = 1")))
    return store.tasks().select("task_id", "generation")


@query(f"""{FOLDED}, d AS (SELECT task_id, split_part(task_id, '___', 2)::INT AS day FROM t)
SELECT task_id FROM d WHERE NOT TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (day + 3) <= TIMESTAMP '{NOW}'""")
def store_expiry(spark, sf_dir):
    """Tasks by generation of their week; expiry rewrites those with expired tasks, and what is not needed any more is deleted."""
    store = TaskStore(spark, files.work_dir(spark, "tasks"), buckets=4)
    t = _tasks(spark, sf_dir, True)
    day = F.split_part("task_id", F.lit("___"), F.lit(2)).cast("int")
    t = t.withColumns({"date_to_delete": F.expr("make_timestamp(2024, 1, 1, 0, 0, 0)") + F.make_dt_interval(day + 3), "week": F.floor((day - 1) / 7)})
    t = files.stored(t.sortWithinPartitions("week"), "dated")  # in this order a week's pages are read, and no others
    for week in range(5):
        store.append(t.filter(F.col("week") == week))
        store.roll_over()
    store.expire(_now())
    store.vacuum()
    return store.tasks().select("task_id")


@query(f"""{FOLDED}, d AS (SELECT task_id, (split_part(task_id, '___', 2)::INT - 1) // 10 AS w FROM t), n AS (SELECT w, count(*) AS n, (SELECT count(*) FROM t) // 2 AS most FROM d GROUP BY w),
g AS (SELECT w, 1 AS generation, n AS held FROM n WHERE w = 0 UNION ALL SELECT n.w, g.generation + CASE WHEN g.held > n.most THEN 1 ELSE 0 END, CASE WHEN g.held > n.most THEN 0 ELSE g.held END + n.n FROM g JOIN n ON n.w = g.w + 1)
SELECT d.task_id, g.generation FROM d JOIN g ON g.w = d.w""")
def generations_by_size(spark, sf_dir):
    """Tasks of ten days at a time; when the newest generation has more than half of all, the next one begins."""
    store = TaskStore(spark, files.work_dir(spark, "tasks"), buckets=4)
    t = files.stored(_tasks(spark, sf_dir, True), "folded")
    most, day = t.count() // 2, F.split_part("task_id", F.lit("___"), F.lit(2)).cast("int")
    for w in range(3):
        store.append(t.filter(F.floor((day - 1) / 10) == w), new=True)
        store.roll_over_if(rows=most)
    return store.tasks().select("task_id", "generation")


@query(f"""{FOLDED}, d AS (SELECT task_id, (split_part(task_id, '___', 2)::INT - 1) // 6 AS w FROM t), n AS (SELECT w, count(*) AS n, (SELECT count(*) FROM t) // 2 AS most FROM d GROUP BY w),
g AS (SELECT w, w AS first, n AS held FROM n WHERE w = 0 UNION ALL SELECT n.w, CASE WHEN g.held + n.n <= n.most THEN g.first ELSE n.w END, CASE WHEN g.held + n.n <= n.most THEN g.held ELSE 0 END + n.n FROM g JOIN n ON n.w = g.w + 1)
SELECT d.task_id, (1 + max(g.w) OVER (PARTITION BY g.first))::INT AS generation FROM d JOIN g ON g.w = d.w""")
def generations_packed(spark, sf_dir):
    """A generation for each six days; neighbours with at most half of all tasks are brought together."""
    store = TaskStore(spark, files.work_dir(spark, "tasks"), buckets=4)
    t = files.stored(_tasks(spark, sf_dir, True), "folded")
    day = F.split_part("task_id", F.lit("___"), F.lit(2)).cast("int")
    for w in range(5):
        store.append(t.filter(F.floor((day - 1) / 6) == w), new=True)
        store.roll_over()
    store.pack(t.count() // 2)
    return store.tasks().select("task_id", "generation")


@query(f"{FOLDED} SELECT task_id, status FROM t WHERE split_part(task_id, '___', 2)::INT % 5 = 0")
def stored_by_ids(spark, sf_dir):
    """Some tasks of a compacted table and of parts that came after, found by their slots and pages."""
    store = TaskStore(spark, files.work_dir(spark, "tasks"), buckets=8, page_rows=100)
    t = files.stored(_tasks(spark, sf_dir, True), "folded")
    user = F.regexp_extract("task_id", "([0-9]+)___", 1).cast("int")
    store.append(t.filter(user % 3 > 0))
    store.compact()
    store.append(t.filter(user % 3 == 0))
    return store.tasks(ids=t.filter(F.split_part("task_id", F.lit("___"), F.lit(2)).cast("int") % 5 == 0)).select("task_id", "status")


@query(f"{FOLDED} SELECT task_id, status FROM t WHERE task_id NOT IN (SELECT task_id FROM t WHERE status = 'CORRUPTED')")
def delete_by_ids(spark, sf_dir):
    t = files.stored(_tasks(spark, sf_dir), "folded")
    return lifecycle.delete_by_ids(t, t.filter(F.col("status") == M.CORRUPTED).select("env", "task_id")).select("task_id", "status")


@query(f"""{FOLDED} SELECT env, task_id, status FROM t, (VALUES ('a'), ('b')) v(env) WHERE env = 'b' AND status <> 'SUCCESS' OR env = 'a' AND status <> 'CORRUPTED'
UNION ALL SELECT 'found', task_id, status FROM t WHERE status = 'SUCCESS'""")
def ids_of_two_environments(spark, sf_dir):
    """Each task in two environments: deleted in one by its status, in the other by another; and read by the id and one environment."""
    t = _tasks(spark, sf_dir).drop("env").withColumn("env", F.explode(F.array(F.lit("a"), F.lit("b"))))
    t = files.stored(t.select(*M.TASK.names[:4]), "two-environments")
    bad, good = F.col("status") == M.CORRUPTED, F.col("status") == M.SUCCESS
    left = lifecycle.delete_by_ids(t, t.filter((F.col("env") == "a") & bad | (F.col("env") == "b") & good))
    found = lookup.single_by_ids(t.withColumn("generation", F.lit(1)), t.filter(good & (F.col("env") == "a")))
    return left.select("env", "task_id", "status").unionByName(found.select(F.lit("found").alias("env"), "task_id", "status"))


@query(f"{S} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY coalesce(name, id_name), date_trunc('day', time) ORDER BY seq) AS rn FROM s) q WHERE rn <= 3")
def rate_limited_over_batches(spark, sf_dir):
    """The log in four micro-batches by order, the third one given twice as after a failure: a limit that holds over all of them."""
    e = logs.session_log(spark, sf_dir)
    top = (e.agg(F.max("seq")).first()[0] or 0) + 1
    counts = Recent(spark, files.work_dir(spark, "limits"), "name string, period long, n long", 24)
    settings, out = ingest.Settings(limit=3, period="1 day"), {}
    for number in (0, 1, 2, 2, 3):
        batch = e.filter((F.col("seq") * 4 >= top * number) & (F.col("seq") * 4 < top * (number + 1)))
        out[number] = ingest.limit_across(batch, settings, counts, number, number).select("seq")
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"{FOLDED} SELECT task_id, status FROM t WHERE status IN ('SUCCESS', 'UNTERMINATED') AND NOT task_id LIKE 'session_1%' AND task_id IN (SELECT task_id FROM s WHERE event_type = 'click')")
def filtered_by_ids(spark, sf_dir):
    """Tasks with one of many ids that pass a filter and do not pass another one."""
    ids = logs.session_log(spark, sf_dir).filter(F.col("context")["last_type"] == "click").select("task_id")
    found = lookup.by_ids(_tasks(spark, sf_dir), ids, [F.col("status").isin(M.SUCCESS, M.UNTERMINATED)], [F.col("task_id").like("session_1%")])
    return found.select("task_id", "status")


@query(f"{FOLDED} SELECT task_id, CASE WHEN status = 'SUCCESS' THEN 3 WHEN status = 'ERROR' THEN 2 ELSE 1 END::BIGINT AS documents FROM t WHERE task_id IN (SELECT task_id FROM s WHERE event_type = 'click')")
def documents_of_ids(spark, sf_dir):
    """How many documents each of many ids has over all generations."""
    t = _tasks(spark, sf_dir).drop("generation")
    n = F.when(F.col("status") == M.SUCCESS, 3).when(F.col("status") == M.ERROR, 2).otherwise(1)
    t = t.withColumn("generation", F.explode(F.sequence(F.lit(1), n)))
    ids = logs.session_log(spark, sf_dir).filter(F.col("context")["last_type"] == "click").select("task_id")
    return lookup.by_ids(t, ids).groupBy("task_id").agg(F.count(F.lit(1)).alias("documents"))


@query(f"{S} SELECT task_id, arg_max(k, seq)::VARCHAR AS k, 1 AS keys FROM s GROUP BY task_id")
def field_projection(spark, sf_dir):
    """One value of a map by its name, and the map without it; whole numbers are shown without a point."""
    t = _tasks(spark, sf_dir, True).withColumn("shown", lookup.as_numbers(F.col("metric")))
    some = lookup.fields(t, ["task_id", "shown.k", "metric.*"], ["metric.k"])
    return some.select("task_id", F.col("`shown.k`").alias("k"), F.size("metric").alias("keys"))


@query(f"""{FOLDED}, n AS (SELECT task_id, arg_min(coalesce(name, id_name), seq) AS name, arg_min(parent_id, seq) FILTER (WHERE parent_id IS NOT NULL) AS parent_id, arg_max(event_type, seq) AS last_type FROM s GROUP BY task_id)
SELECT task_id, name, parent_id, last_type FROM n""")
def parent_fields(spark, sf_dir):
    p = lookup.parents(_tasks(spark, sf_dir, True))
    return p.select("task_id", "name", "parent_id", F.col("ctx")["last_type"].alias("last_type"))


@query("""WITH g AS (SELECT day(ts) AS g, count(*) AS n FROM events GROUP BY day(ts)), b AS (SELECT max(n) * 100 AS most FROM g),
s AS (SELECT g, row_number() OVER (ORDER BY g) AS rn FROM g, b WHERE g <> 4 AND n * 100 < most * 10)
SELECT a.g::INT AS source, z.g::INT AS destination FROM s a JOIN s z ON z.rn = a.rn + 1 WHERE a.rn % 2 = 1""")
def compaction_pairs(spark, sf_dir):
    """Neighbouring small generations (here: days of events, which no alias but that of day 4 holds) in pairs."""
    e = logs.table(spark, sf_dir, "events").groupBy(F.day("ts").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["g"]: r["n"] for r in e.collect()}  # a row per generation
    pairs = lifecycle.mergeable(sizes, {4}, max(sizes.values(), default=0) * 100)
    return spark.createDataFrame(pairs, "source int, destination int")


# plugins, retries, reports


class _Broken:
    """A plugin that fails while its plan is made, or only when a row meets it."""

    def __init__(self, name: str):
        self.name = name

    def apply(self, events):
        return events.withColumn("name", F.col("no_such_column") if self.name == "broken" else F.when(F.col("type") == M.INFO, F.raise_error(F.lit("no"))).otherwise(F.col("name")))


@query("SELECT * FROM (VALUES ('SwitchCase_0', 'SwitchCase', 'SUCCESS', false), ('broken', '_Broken', 'ERROR', true), ('failing', '_Broken', 'ERROR', true), ('late', 'SwitchCase', 'SUCCESS', false)) v(name, class, status, failed)")
def plugin_reports(spark, sf_dir):
    """What is written about plugins from JSON, and about two that fail and are passed over."""
    rules = plugins.from_json('[{"class": "a.b.SwitchCase", "searchField": "props", "outputAttribute": "o", "switch": [{"output": "x"}]}, {"class": "SwitchCase", "name": "late", "searchField": "props", "outputAttribute": "p", "switch": []}]')
    _, notes = plugins.run_all(logs.session_log(spark, sf_dir), [rules[0], _Broken("broken"), _Broken("failing"), rules[1]], proven=True)
    return spark.createDataFrame(notes, plugins.REPORT).select("name", "class", "status", F.col("error").isNotNull().alias("failed"))


@query("""WITH RECURSIVE a AS (SELECT event_id AS item, 1 AS round, event_id % 7 = 0 AS ok FROM events UNION ALL SELECT item, round + 1, (item + round) % 7 = 0 FROM a WHERE NOT ok AND round < 3)
SELECT item, max(round)::INT AS attempts, bool_or(ok) AS ok FROM a GROUP BY item""")
def dead_letter_replay(spark, sf_dir):
    """Items that failed are sent again, round by round, as long as a round has a success and no item has been tried three times."""
    items = logs.table(spark, sf_dir, "events").select(F.col("event_id").alias("item"))
    sent = telemetry.replayed(items, lambda df, turn: df.withColumn("ok", (F.col("item") + turn - 1) % 7 == 0), most=3)
    return sent.select("item", "attempts", "ok")


# the client


def _client_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that clients emit: for each customer a visit with a call that fails for some, a spot and a statement without a task.
    ``value``: an event as JSON; ``seq_base``: its place, which grows within a customer.

    Emitting takes far more time than reading, so customers are dealt out to as many tasks as a shuffle has, however few files hold them."""

    def emit(batches):
        for batch in batches:
            out, at = [], []
            for key, segment in zip(batch["c_custkey"].to_pylist(), batch["c_mktsegment"].to_pylist()):
                ticks = iter(range(100))
                sink = StatisticsSink(MemorySink())
                tracer = Tracer(sink, "prod", {"host": "h"}, clock=lambda ticks=ticks: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=next(ticks)))

                @tracer.traced("call", log_arguments=True)
                def call(x, y, tracer=tracer):
                    tracer.metric("x", x)
                    if x % 3 == 0:
                        raise KeyError(x)
                    return y

                visit = tracer.start("visit", Params().add_context("customer", key).add_context("segment", segment), task_id=f"visit___{key}")
                try:
                    call(key, y=segment)
                    tracer.spot("ping")
                    tracer.for_task(visit).start_child("child").success()
                    tracer.success(visit)
                except KeyError as e:
                    tracer.error(e, visit)
                tracer.string("lost", key)
                tracer.heartbeat(sink)
                out += [json.dumps(x | {"strings": x["strings"] | {"customer_": str(key)}}) for x in sink.sink.events]
                at += [key * 100 + i for i in range(len(sink.sink.events))]
            yield pa.RecordBatch.from_pydict({"value": out, "seq_base": at}, schema=pa.schema([("value", pa.string()), ("seq_base", pa.int64())]))

    customers = logs.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return customers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey").mapInArrow(emit, "value string, seq_base long")


def _client_events(spark, sf_dir) -> DataFrame:
    emitted = files.stored(_client_rows(spark, sf_dir), "emitted")  # ids are drawn, so they are drawn once
    lines = emitted.select(F.concat(F.lit('{"events":['), "value", F.lit("]}")).alias("value"), "seq_base")
    return files.stored(files.events_of(files.envelopes_from_text(lines)), "events")


def _client_tasks(spark, sf_dir) -> DataFrame:
    """Tasks with roots and inherited context."""
    tasks, _, _ = ingest.fold_batch(_client_events(spark, sf_dir), ingest.Settings(), _now())
    tasks = files.stored(tasks, "tasks")
    rest = tuple(c for c in tasks.columns if c not in ("task_id", "parent_id", "name", "ctx", "primary_id", "parents_path", "orphan"))
    return hierarchy.resolve(tasks, carried=rest)


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_custkey % 3 = 0 AS bad FROM customer)
SELECT k, 'visit' AS name, CASE WHEN bad THEN 'ERROR' ELSE 'SUCCESS' END AS status, NULL::VARCHAR AS path, concat('visit___', k::VARCHAR) AS primary_id, segment, CASE WHEN bad THEN 'KeyError' END AS exception, NULL::VARCHAR AS arg0, 'h' AS host FROM c
UNION ALL SELECT k, 'call', CASE WHEN bad THEN 'ERROR' ELSE 'SUCCESS' END, 'visit', concat('visit___', k::VARCHAR), segment, CASE WHEN bad THEN 'KeyError' END, k::VARCHAR, 'h' FROM c
UNION ALL SELECT k, 'ping', 'SUCCESS', 'visit', concat('visit___', k::VARCHAR), segment, NULL, NULL, 'h' FROM c WHERE NOT bad
UNION ALL SELECT k, 'child', 'SUCCESS', 'visit', concat('visit___', k::VARCHAR), segment, NULL, NULL, 'h' FROM c WHERE NOT bad
UNION ALL SELECT k, 'LogWithoutContext', 'CORRUPTED', NULL, NULL, NULL, NULL, NULL, 'h' FROM c""")
def client_tasks(spark, sf_dir):
    """Tasks by context manager, decorator, handle and spot, with nesting, arguments, errors, static strings and what has no task."""
    t = _client_tasks(spark, sf_dir)
    own = F.col("name") == M.NO_CONTEXT
    return t.select(
        F.col("string")["customer_"].cast("long").alias("k"), "name", "status", F.array_join("parents_path", ">").alias("path"), F.when(~own, F.col("primary_id")).alias("primary_id"), F.col("ctx")["segment"].alias("segment"), F.col("string")["exceptionType"].alias("exception"), F.col("string")["arg0"].alias("arg0"), F.col("string")["host"].alias("host")
    )


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 6 ELSE 9 END::BIGINT AS submitted FROM customer")
def client_heartbeats(spark, sf_dir):
    """Each client's heartbeat says how many events it has sent since the last one."""
    _, beats = ingest.admitted(_client_events(spark, sf_dir), ingest.Settings())
    return beats.select(F.from_json("strings", "map<string,string>")["customer_"].cast("long").alias("k"), F.from_json("metrics", "map<string,double>")["submitAmount"].cast("long").alias("submitted"))


# streams


@query("""WITH k AS (SELECT o_custkey AS c, o_orderkey AS o FROM orders)
SELECT env, concat('customer___', c::VARCHAR) AS task_id, max(o)::VARCHAR AS last, count(*)::VARCHAR AS n FROM k, (VALUES ('a'), ('b')) v(env) GROUP BY env, c""")
def stream_to_store(spark, sf_dir):
    """Envelope files through the stream to the store: of a customer's orders, in the order of its lines, the last one wins, in each of two environments."""
    path = files.work_dir(spark, "stream")
    key = F.col("o_orderkey")
    o = logs.table(spark, sf_dir, "orders")
    n = F.row_number().over(logs.by("o_custkey", "o_orderkey"))
    e = o.select("o_custkey", key, n.alias("n")).withColumn("env", F.explode(F.array(F.lit("a"), F.lit("b"))))
    wire = F.to_json(F.struct(F.concat_ws("-", "env", key.cast("string")).alias("id"), F.array(F.struct(
        F.when(F.col("n") == 1, M.START).otherwise(M.INFO).alias("@type"), F.concat(F.lit("customer___"), F.col("o_custkey").cast("string")).alias("taskId"), F.lit("2024-01-01T00:00:00Z").alias("time"), F.when(F.col("n") == 1, F.lit("customer")).alias("name"), "env",
        F.create_map(F.lit("last"), key.cast("string"), F.lit("n"), F.col("n").cast("string")).alias("strings"),
    )).alias("events")))
    # a customer's lines are in one file, in order
    e.select("o_custkey", "env", key, wire.alias("value")).repartition("o_custkey").sortWithinPartitions(key, "env").select("value").write.text(f"{path}/in")
    store = TaskStore(spark, f"{path}/store", buckets=4)
    run = ingest.stream(spark, f"{path}/in", store, f"{path}/check", dead=f"{path}/dead", reports=f"{path}/reports")
    run.awaitTermination()
    return store.tasks().select("env", "task_id", F.col("string")["last"].alias("last"), F.col("string")["n"].alias("n"))


@query("""SELECT concat('order___', o_orderkey::VARCHAR) AS what, 1::BIGINT AS n FROM orders WHERE o_orderkey % 4 < 3
UNION ALL SELECT concat('letters read ', a::VARCHAR), count(*) FROM orders, (VALUES (1), (2), (3)) v(a) WHERE o_orderkey % 4 = 3 OR o_orderkey % 4 = 2 AND a = 1 GROUP BY a""")
def dead_letters_of_a_stream(spark, sf_dir):
    """Lines that no envelope could be made of are mended and sent again through the stream: what is mended arrives once, the rest is read three times."""
    path = files.work_dir(spark, "letters")
    _lines(spark, sf_dir).select("value").write.text(f"{path}/in")
    store = TaskStore(spark, f"{path}/store", buckets=4)
    event = '{"@type":"InfoEvent","taskId":"order___$1","time":"2024-01-01T00:00:00Z"}'
    mend = lambda line: F.regexp_replace(line, r'^\{"id":([0-9]+),"events":\[$', '{"id":"w$1","events":[' + event + "]}")
    run = lambda: ingest.stream(spark, f"{path}/in", store, f"{path}/check", dead=f"{path}/dead").awaitTermination()
    run()
    while ingest.send_again(spark, f"{path}/dead", f"{path}/check", mend):
        run()
    letters = spark.read.schema(ingest.LETTER).json(f"{path}/dead/batch=*")
    counted = letters.groupBy(F.concat(F.lit("letters read "), F.col("attempts").cast("string")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return store.tasks().groupBy(F.col("task_id").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(counted)


@query("""SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS env, epoch_ms(date_trunc('hour', ts)) // 1000 AS period_start, count(*) AS amount, sum(event_id % 1000)::DOUBLE / count(*) AS avg_value, max(event_id % 1000)::DOUBLE AS max_value
FROM events GROUP BY ALL""")
def heartbeats_of_a_stream(spark, sf_dir):
    """Client heartbeats through the stream, those of the later days first: each hour's figures, to which late beats add."""
    path = files.work_dir(spark, "beats")
    e = logs.table(spark, sf_dir, "events")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    beat = F.struct(
        F.lit(M.SPOT).alias("@type"), F.lit(M.HEARTBEAT).alias("name"), F.concat(F.lit("beat___"), F.col("event_id").cast("string")).alias("taskId"), at.alias("time"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("env"),
        F.create_map(F.lit("client"), F.col("event_id").cast("string")).alias("strings"), F.create_map(F.lit("submitAmount"), (F.col("event_id") % 1000).cast("double")).alias("metrics"),
    )
    lines = e.select(F.day("ts").alias("day"), F.to_json(F.struct(F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("id"), F.array(beat).alias("events"))).alias("value"))
    store = TaskStore(spark, f"{path}/store", buckets=2)
    for part in ("day > 15", "day <= 15"):
        lines.filter(part).select("value").write.mode("append").text(f"{path}/in")
        ingest.stream(spark, f"{path}/in", store, f"{path}/check", ingest.Settings(beat_period="1 hour"), reports=f"{path}/reports").awaitTermination()
    found = ingest.heartbeats_of(spark, f"{path}/reports").filter("metric = 'submitAmount'")
    return found.select("env", F.unix_seconds("period_start").alias("period_start"), "amount", "avg_value", "max_value")
