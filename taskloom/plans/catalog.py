"""All queries of the task-event engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import normalize as N
from ..operators import admission, fold, hierarchy, lifecycle, lookup, merge, plugins, telemetry
from ..sources import files
from . import logs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The time that "now" means in all queries.
NOW = "2024-01-20 12:34:56"
DAYS = 10


def _now():
    return F.lit(NOW).cast("timestamp")


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_CLOSE = """CASE WHEN f.status = 'UNTERMINATED' THEN '{own}' WHEN f.status IN ('{other}', 'PARTIAL_{other}') THEN 'CORRUPTED'
    WHEN f.status IN ('{own}', 'PARTIAL_{own}') THEN CASE WHEN f.e <> o.time THEN 'CORRUPTED' ELSE f.status END ELSE 'PARTIAL_{own}' END"""


def _fold_sql(events: str) -> str:
    """The status machine walked event by event; ``events`` has task_id, seq, time, type."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY task_id) AS n_events FROM {events}),
f AS (
  SELECT task_id, rn, n_events, CASE type WHEN 'StartEvent' THEN 'UNTERMINATED' WHEN 'SuccessEvent' THEN 'PARTIAL_SUCCESS' WHEN 'ErrorEvent' THEN 'PARTIAL_ERROR' ELSE 'PARTIAL_INFO_ONLY' END AS status,
    CASE WHEN type = 'StartEvent' THEN time END AS b, CASE WHEN type IN ('SuccessEvent', 'ErrorEvent') THEN time END AS e, time AS first_time, NULL::VARCHAR AS reason FROM o WHERE rn = 1
  UNION ALL
  SELECT o.task_id, o.rn, o.n_events,
    CASE WHEN f.status = 'CORRUPTED' OR o.type = 'InfoEvent' THEN f.status
      WHEN o.type = 'StartEvent' THEN CASE WHEN f.status IN ('UNTERMINATED', 'SUCCESS', 'ERROR') THEN CASE WHEN f.b <> o.time THEN 'CORRUPTED' ELSE f.status END
        WHEN f.status = 'PARTIAL_SUCCESS' THEN 'SUCCESS' WHEN f.status = 'PARTIAL_ERROR' THEN 'ERROR' ELSE 'UNTERMINATED' END
      WHEN o.type = 'SuccessEvent' THEN {_CLOSE.format(own="SUCCESS", other="ERROR")}
      ELSE {_CLOSE.format(own="ERROR", other="SUCCESS")} END,
    coalesce(f.b, CASE WHEN o.type = 'StartEvent' THEN o.time END), coalesce(f.e, CASE WHEN o.type IN ('SuccessEvent', 'ErrorEvent') THEN o.time END), f.first_time,
    CASE WHEN f.status = 'CORRUPTED' OR o.type = 'InfoEvent' THEN f.reason
      WHEN o.type = 'StartEvent' THEN CASE WHEN f.status IN ('UNTERMINATED', 'SUCCESS', 'ERROR') AND f.b <> o.time THEN '{M.STARTED_TIME}' END
      WHEN (o.type = 'SuccessEvent' AND f.status IN ('ERROR', 'PARTIAL_ERROR')) OR (o.type = 'ErrorEvent' AND f.status IN ('SUCCESS', 'PARTIAL_SUCCESS')) THEN '{M.CLOSED_STATUS}'
      WHEN f.status LIKE '%SUCCESS' AND o.type = 'SuccessEvent' AND f.e <> o.time OR f.status LIKE '%ERROR' AND o.type = 'ErrorEvent' AND f.e <> o.time THEN '{M.CLOSED_TIME}' END
  FROM f JOIN o ON o.task_id = f.task_id AND o.rn = f.rn + 1),
t AS (SELECT task_id, status, coalesce(b, first_time) AS task_begin, e AS task_end, reason FROM f WHERE rn = n_events)"""


S = f"WITH RECURSIVE s AS ({logs.SESSION_SQL})"
FOLDED = f"{S}, {_fold_sql('s')}"


def _tasks(spark: SparkSession, sf_dir: str, with_maps: bool = False, events: DataFrame | None = None) -> DataFrame:
    return fold.fold(logs.session_log(spark, sf_dir) if events is None else events, _now(), DAYS, with_maps=with_maps)


# folding


@query(f"{FOLDED} SELECT status, count(*) AS tasks FROM t GROUP BY status")
def task_status_counts(spark, sf_dir):
    return _tasks(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


@query(f"{FOLDED} SELECT task_id, status FROM t")
def task_status_fold(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_id", "status")


@query(f"""{FOLDED}, n AS (SELECT task_id, arg_min(coalesce(name, id_name), seq) AS name, arg_min(parent_id, seq) FILTER (WHERE parent_id IS NOT NULL) AS parent_id FROM s GROUP BY task_id)
SELECT t.task_id, n.name, n.parent_id, (epoch_us(task_begin) // 1000) AS begin_ms, (epoch_us(task_end) // 1000) AS end_ms,
  CASE WHEN status IN ('SUCCESS', 'ERROR') THEN (epoch_us(task_end) - epoch_us(task_begin)) // 1000 END AS duration FROM t JOIN n ON t.task_id = n.task_id""")
def task_lifecycle(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_id", "name", "parent_id", F.unix_millis("task_begin").alias("begin_ms"), F.unix_millis("task_end").alias("end_ms"), "duration")


@query(f"{FOLDED} SELECT task_id, reason FROM t WHERE status = 'CORRUPTED'")
def task_corruption_reason(spark, sf_dir):
    return _tasks(spark, sf_dir).filter(F.col("status") == M.CORRUPTED).select("task_id", "reason")


@query(f"{S} SELECT task_id, 'value' AS key, arg_max(value, seq) AS value FROM s GROUP BY task_id UNION ALL SELECT task_id, 'k', arg_max(k, seq)::DOUBLE FROM s GROUP BY task_id")
def task_metric_last_write(spark, sf_dir):
    return _tasks(spark, sf_dir, True).select("task_id", F.explode("metric").alias("key", "value"))


@query(f"{S} SELECT task_id, 'last_type' AS key, arg_max(event_type, seq) AS value FROM s GROUP BY task_id")
def task_context_last_write(spark, sf_dir):
    return _tasks(spark, sf_dir, True).select("task_id", F.explode("ctx").alias("key", "value"))


@query(f"{S} SELECT DISTINCT task_id, (epoch_us(date_trunc('day', TIMESTAMP '{NOW}' + INTERVAL {DAYS} DAY)) // 1000) AS delete_ms FROM s")
def task_retention(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_id", F.unix_millis("date_to_delete").alias("delete_ms"))


@query(f"{FOLDED} SELECT task_id, status FROM t WHERE status LIKE 'PARTIAL%' AND task_begin <= TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE")
def partial_tasks(spark, sf_dir):
    return lifecycle.partials(_tasks(spark, sf_dir), _now()).select("task_id", "status")


# cleaning


@query(f"""WITH i AS (SELECT DISTINCT task_id FROM ({logs.SESSION_SQL}) s UNION SELECT DISTINCT replace(task_id, '___', '_') FROM ({logs.SESSION_SQL}) s UNION SELECT task_id FROM ({logs.TREE_SQL}) q UNION SELECT concat(task_id, '{M.ID_SUFFIX}') FROM ({logs.TREE_SQL}) q),
u AS (SELECT task_id, CASE WHEN task_id LIKE '%{M.ID_SUFFIX.replace("_", "$_")}' ESCAPE '$' THEN left(task_id, length(task_id) - {len(M.ID_SUFFIX)}) ELSE task_id END AS short FROM i)
SELECT task_id, CASE WHEN contains(short, '___') THEN split_part(short, '___', 1) WHEN len(string_split(short, '_')) < 2 THEN task_id
  ELSE array_to_string(string_split(short, '_')[1 : len(string_split(short, '_')) - 2], '_') END AS name FROM u""")
def name_from_id(spark, sf_dir):
    s, t = logs.session_log(spark, sf_dir).select("task_id").distinct(), logs.tree_nodes(spark, sf_dir).select("task_id")
    old = s.select(F.replace("task_id", F.lit("___"), F.lit("_")).alias("task_id"))
    ids = s.union(old).union(t).union(t.select(F.concat("task_id", F.lit(M.ID_SUFFIX)))).distinct()
    return ids.select("task_id", N.name_of(F.lit(None).cast("string"), F.col("task_id")).alias("name"))


_SUFFIXED = f"concat(task_id, CASE length(task_id) % 4 WHEN 1 THEN '{M.ID_SUFFIX}' WHEN 2 THEN '{M.ID_SUFFIX * 2}' WHEN 3 THEN '{M.ID_SUFFIX}x' ELSE '' END)"


@query(f"""WITH i AS (SELECT task_id AS id, {_SUFFIXED} AS raw FROM ({logs.TREE_SQL}) q)
SELECT id, raw, CASE WHEN raw LIKE '%x' OR raw = id THEN raw ELSE replace(raw, '{M.ID_SUFFIX}', '') END AS repaired FROM i""")
def id_suffix_repair(spark, sf_dir):
    i = logs.tree_nodes(spark, sf_dir).select(F.col("task_id").alias("id"), F.expr(_SUFFIXED).alias("raw"))
    return i.withColumn("repaired", N.repair_id(F.col("raw")))


@query(f"""{S} SELECT seq, 'a_b' AS key, concat('2', event_type) AS value FROM s UNION ALL SELECT seq, 'c_d_' || event_type, event_type FROM s""")
def dotted_keys(spark, sf_dir):
    t = F.col("context")["last_type"]
    raw = F.create_map(F.lit("a.b"), F.concat(F.lit("1"), t), F.lit("a_b"), F.concat(F.lit("2"), t), F.concat(F.lit("c.d."), t), t)
    return logs.session_log(spark, sf_dir).select("seq", F.explode(N.plain_keys(raw)).alias("key", "value"))


@query(f"SELECT doc_id, length(substr(text, 1, {M.MAX_KEYWORD_CHARS})) AS chars, md5(substr(text, 1, {M.MAX_KEYWORD_CHARS})) AS digest FROM documents")
def trim_fields(spark, sf_dir):
    m = N.trim_values(F.create_map(F.lit("t"), F.col("text")), M.MAX_KEYWORD_CHARS)["t"]
    return logs.table(spark, sf_dir, "documents").select("doc_id", F.length(m).cast("long").alias("chars"), F.md5(m).alias("digest"))


@query(f"{S} SELECT seq, 'm' AS key, CASE WHEN seq % 17 = 0 THEN 0.0 ELSE value END AS value FROM s WHERE seq % 19 <> 0 OR seq % 17 = 0")
def metric_clean(spark, sf_dir):
    v = F.when(F.col("seq") % 17 == 0, F.lit(float("nan"))).when(F.col("seq") % 19 != 0, F.col("metrics")["value"])
    return logs.session_log(spark, sf_dir).select("seq", F.explode(N.clean_metrics(F.create_map(F.lit("m"), v))).alias("key", "value"))


_SIZE = """length(type) + 47 + length(task_id) + 12 + coalesce(length(name) + 10, 0) + coalesce(length(parent_id) + 14, 0) + 7 + 8
 + length('kind') + length(event_type) + 5 + 13 + length('props') + length(props) + 5 + 10 + length('last_type') + length(event_type) + 5 + 13"""


@query(f"{S} SELECT seq, ({_SIZE})::BIGINT AS size FROM s")
def event_size_estimate(spark, sf_dir):
    e = logs.session_log(spark, sf_dir).withColumn("metrics", F.lit(None).cast(M.EVENT["metrics"].dataType))
    return e.select("seq", N.estimated_size(e).cast("long").alias("size"))


# admission


@query(f"{S} SELECT seq FROM s WHERE regexp_full_match(coalesce(name, id_name), 'session_1.*')")
def skip_filter(spark, sf_dir):
    return admission.keep_named(logs.session_log(spark, sf_dir), "session_1.*").select("seq")


@query(f"{S} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY coalesce(name, id_name), date_trunc('day', time) ORDER BY seq) AS rn FROM s) q WHERE rn <= 2")
def rate_limited(spark, sf_dir):
    return admission.rate_limited(logs.session_log(spark, sf_dir), 2, "1 day").select("seq")


@query("""WITH RECURSIVE e AS (SELECT event_id AS n, user_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT n, id, rn, ts AS opened, true AS let_in FROM e WHERE rn = 1
  UNION ALL SELECT e.n, e.id, e.rn, CASE WHEN e.ts >= w.opened + INTERVAL 12 HOUR THEN e.ts ELSE w.opened END, e.ts >= w.opened + INTERVAL 12 HOUR FROM w JOIN e ON e.id = w.id AND e.rn = w.rn + 1)
SELECT n FROM w WHERE let_in""")
def wrapper_dedup(spark, sf_dir):
    """Of arrivals with one id (here: a user's events), those that come within half a day of the last one let in are dropped."""
    e = logs.table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("received"))
    return admission.once_per_window(e, seconds=43200, order="n").select("n")


@query(f"""{S}, e AS (SELECT seq, id_name, time, 100 + length(props) AS size, row_number() OVER (PARTITION BY id_name ORDER BY seq) AS rn FROM s),
b AS (SELECT seq, id_name, rn, 0::BIGINT AS batch, size::BIGINT AS filled, time AS began FROM e WHERE rn = 1
  UNION ALL SELECT e.seq, e.id_name, e.rn, CASE WHEN b.filled > 1000 OR e.time - b.began > INTERVAL 5 DAY THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.filled > 1000 OR e.time - b.began > INTERVAL 5 DAY THEN 0 ELSE b.filled END + e.size, CASE WHEN b.filled > 1000 OR e.time - b.began > INTERVAL 5 DAY THEN e.time ELSE b.began END
  FROM b JOIN e ON e.id_name = b.id_name AND e.rn = b.rn + 1)
SELECT seq, batch FROM b""")
def batch_by_size(spark, sf_dir):
    """A client's events in batches: each takes events until its size exceeds the limit, or its time is over."""
    e = logs.session_log(spark, sf_dir).withColumn("client", N.name_of(F.col("name"), F.col("task_id")))
    return admission.by_size(e, 1000, F.length(F.col("text")["props"]) + 100, "client", 5 * 86400).select("seq", "batch")


@query(f"""{S}, e AS (SELECT seq, time, row_number() OVER (ORDER BY seq) AS rn, sum(100 + length(props)) OVER (ORDER BY seq) - (100 + length(props)) AS filled FROM s),
b AS (SELECT 0::BIGINT AS batch, 1::BIGINT AS rn, (SELECT filled FROM e WHERE rn = 1) AS filled, (SELECT time FROM e WHERE rn = 1) AS began
  UNION ALL SELECT n.batch, n.rn, e.filled, e.time FROM (SELECT batch + 1 AS batch, (SELECT min(e.rn) FROM e WHERE e.rn > b.rn AND (e.filled - b.filled > 20000 OR e.time - b.began > INTERVAL 20 DAY)) AS rn FROM b) n JOIN e ON e.rn = n.rn)
SELECT e.seq, max(b.batch)::BIGINT AS batch FROM e JOIN b ON b.rn <= e.rn GROUP BY e.seq""")
def batch_one_queue(spark, sf_dir):
    """All events in one queue, which is cut in many slices at once."""
    e = logs.session_log(spark, sf_dir)
    return admission.by_size(e, 20000, F.length(F.col("text")["props"]) + 100, "env", 20 * 86400, slice_rows=1024).select("seq", "batch")


# the tree

TREE = f"""WITH RECURSIVE n AS ({logs.TREE_SQL}),
r AS (SELECT task_id, task_id AS primary_id, NULL::VARCHAR AS path, 0::BIGINT AS depth, name FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.task_id, r.primary_id, CASE WHEN r.path IS NULL THEN r.name ELSE concat(r.path, '>', r.name) END, r.depth + 1, n.name FROM r JOIN n ON n.parent_id = r.task_id)"""


@query(f"{TREE} SELECT task_id, path, depth FROM r")
def parent_path(spark, sf_dir):
    t = hierarchy.resolve(logs.tree_nodes(spark, sf_dir))
    return t.filter("NOT coalesce(orphan, false)").select("task_id", F.array_join("parents_path", ">").alias("path"), "depth")


@query(f"{TREE} SELECT task_id, primary_id FROM r")
def primary_id(spark, sf_dir):
    return hierarchy.resolve(logs.tree_nodes(spark, sf_dir)).filter("primary_id IS NOT NULL").select("task_id", "primary_id")


@query(f"""WITH RECURSIVE n AS ({logs.TREE_SQL}),
c AS (SELECT task_id, ctx_key AS key, ctx_value AS value, 0 AS up, parent_id, task_id AS at FROM n
  UNION ALL SELECT c.task_id, n.ctx_key, n.ctx_value, c.up + 1, n.parent_id, n.task_id FROM c JOIN n ON n.task_id = c.parent_id),
whole AS (SELECT task_id FROM c WHERE parent_id IS NULL)
SELECT task_id, key, arg_min(value, up) AS value FROM c WHERE task_id IN (SELECT task_id FROM whole) GROUP BY task_id, key""")
def context_inheritance(spark, sf_dir):
    t = hierarchy.resolve(logs.tree_nodes(spark, sf_dir))
    return t.filter("NOT coalesce(orphan, false)").select("task_id", F.explode("ctx").alias("key", "value"))


@query(f"{TREE} SELECT task_id FROM n WHERE task_id NOT IN (SELECT task_id FROM r)")
def orphans(spark, sf_dir):
    return hierarchy.resolve(logs.tree_nodes(spark, sf_dir)).filter("orphan").select("task_id")


@query(f"WITH n AS ({logs.TREE_SQL}) SELECT parent_id, count(*) AS waiting, min(task_id) AS first_child FROM n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT task_id FROM n) GROUP BY parent_id")
def orphan_index(spark, sf_dir):
    return hierarchy.orphan_index(logs.tree_nodes(spark, sf_dir))


@query(f"WITH n AS ({logs.TREE_SQL}) SELECT DISTINCT parent_id FROM n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT task_id FROM n)")
def missing_parents(spark, sf_dir):
    return hierarchy.missing_parents(logs.tree_nodes(spark, sf_dir))


@query(f"""{TREE}, early AS (SELECT * FROM n WHERE task_id NOT LIKE 'nation%'),
er AS (SELECT task_id FROM early WHERE parent_id IS NULL UNION ALL SELECT e.task_id FROM er JOIN early e ON e.parent_id = er.task_id)
SELECT n.task_id, CASE WHEN r.task_id IS NULL THEN true WHEN n.task_id LIKE 'nation%' OR n.task_id IN (SELECT task_id FROM er) THEN NULL ELSE false END AS orphan, r.primary_id
FROM n LEFT JOIN r ON r.task_id = n.task_id""")
def adoption(spark, sf_dir):
    """Nations come after everything else; what waited below them is adopted."""
    nodes = logs.tree_nodes(spark, sf_dir)
    late = F.startswith("task_id", F.lit("nation"))
    first = hierarchy.resolve(nodes.filter(~late))
    return hierarchy.adopt(first, nodes.filter(late)).select("task_id", "orphan", "primary_id")


@query(f"""{S}, n AS (SELECT task_id, arg_min(parent_id, seq) FILTER (WHERE parent_id IS NOT NULL) AS parent_id FROM s WHERE type = 'StartEvent' GROUP BY task_id),
r AS (SELECT task_id, 0::BIGINT AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.task_id, r.depth + 1 FROM r JOIN n ON n.parent_id = r.task_id)
SELECT depth, count(*) AS tasks FROM r GROUP BY depth""")
def session_chain_depth(spark, sf_dir):
    starts = logs.session_log(spark, sf_dir).filter(F.col("type") == M.START)
    nodes = starts.groupBy("task_id").agg(F.expr("min_by(parent_id, seq) FILTER (WHERE parent_id IS NOT NULL)").alias("parent_id"), F.min_by("name", "seq").alias("name"), F.min_by(F.col("context")["last_type"], "seq").alias("t"))
    tree = hierarchy.resolve(nodes.select("task_id", "parent_id", "name", F.create_map(F.lit("last_type"), "t").alias("ctx")))
    return tree.filter("depth IS NOT NULL").groupBy("depth").agg(F.count(F.lit(1)).alias("tasks"))


@query(f"{TREE} SELECT primary_id, count(*) AS tasks, max(depth) AS max_depth FROM r GROUP BY primary_id")
def subtree_rollup(spark, sf_dir):
    return lookup.subtree_rollup(hierarchy.resolve(logs.tree_nodes(spark, sf_dir)))


# merging

_GRID = "(VALUES ('UNTERMINATED'), ('SUCCESS'), ('ERROR'), ('PARTIAL_SUCCESS'), ('PARTIAL_ERROR'), ('PARTIAL_INFO_ONLY'), ('CORRUPTED'))"
#: Status after a merge from old status a, new status b and whether begins (sb) and ends (se) agree.
_MERGED = """CASE WHEN b = 'CORRUPTED' OR a = 'CORRUPTED' THEN 'CORRUPTED' WHEN b = 'PARTIAL_INFO_ONLY' THEN a
 WHEN a IN ('SUCCESS', 'ERROR') THEN CASE WHEN b = a THEN CASE WHEN se AND sb THEN a ELSE 'CORRUPTED' END WHEN b = 'UNTERMINATED' THEN CASE WHEN sb THEN a ELSE 'CORRUPTED' END
   WHEN b = concat('PARTIAL_', a) THEN CASE WHEN se THEN a ELSE 'CORRUPTED' END ELSE 'CORRUPTED' END
 WHEN a = 'UNTERMINATED' THEN CASE WHEN b LIKE 'PARTIAL%' THEN replace(b, 'PARTIAL_', '') WHEN sb THEN a ELSE 'CORRUPTED' END
 WHEN a IN ('PARTIAL_SUCCESS', 'PARTIAL_ERROR') THEN CASE WHEN b = 'UNTERMINATED' THEN replace(a, 'PARTIAL_', '') WHEN replace(a, 'PARTIAL_', '') = replace(b, 'PARTIAL_', '') AND se THEN a ELSE 'CORRUPTED' END
 ELSE b END"""


@query(f"WITH g AS (SELECT x.col0 AS a, y.col0 AS b, sb, se FROM {_GRID} x, {_GRID} y, (VALUES (true), (false)) p(sb), (VALUES (true), (false)) q(se)) SELECT a, b, sb, se, {_MERGED} AS status FROM g")
def merge_status_matrix(spark, sf_dir):
    one = spark.range(1)
    states = F.explode(F.array(*map(F.lit, M.STATUSES)))
    flags = F.explode(F.array(F.lit(True), F.lit(False)))
    g = one.select(states.alias("a")).select("a", states.alias("b")).select("a", "b", flags.alias("sb")).select("a", "b", "sb", flags.alias("se"))
    t = lambda same, base: F.timestamp_seconds(F.when(same, F.lit(base)).otherwise(F.lit(base + 5)))
    s = merge.merged_status(F.col("a"), F.col("b"), t(F.lit(True), 100), t(F.col("sb"), 100), t(F.lit(True), 200), t(F.col("se"), 200))
    return g.select("a", "b", "sb", "se", s["status"].alias("status"))


def _halves(spark, sf_dir, with_maps: bool = False) -> tuple[DataFrame, DataFrame]:
    e = logs.session_log(spark, sf_dir)
    return _tasks(spark, sf_dir, with_maps, e.filter("seq % 2 = 0")), _tasks(spark, sf_dir, with_maps, e.filter("seq % 2 = 1"))


_HALF = {k: _fold_sql(f"(SELECT * FROM s WHERE seq % 2 = {k}) h").replace("o AS", f"o{k} AS").replace("f AS", f"f{k} AS").replace("t AS (SELECT task_id", f"t{k} AS (SELECT task_id").replace("FROM o ", f"FROM o{k} ").replace("JOIN o ON", f"JOIN o{k} o ON").replace("FROM f ", f"FROM f{k} f ") for k in (0, 1)}
_BOTH = f"{S}, {_HALF[0]}, {_HALF[1]}, j AS (SELECT coalesce(t0.task_id, t1.task_id) AS task_id, t0.status AS a, t1.status AS b, t0.task_begin IS NOT DISTINCT FROM t1.task_begin AS sb, t0.task_end IS NOT DISTINCT FROM t1.task_end AS se FROM t0 FULL JOIN t1 ON t0.task_id = t1.task_id)"


@query(f"{_BOTH} SELECT task_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE {_MERGED} END AS status FROM j")
def merge_two_batches(spark, sf_dir):
    first, second = _halves(spark, sf_dir, True)
    return merge.upserted(first, second).select("task_id", "status")


@query(f"""{_BOTH}, m AS (SELECT task_id, a, b, sb, se, a LIKE 'PARTIAL%' OR b LIKE 'PARTIAL%' AS part FROM j WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT task_id, 'current' AS generation, {_MERGED} AS status FROM m WHERE part
UNION ALL SELECT task_id, 'current', a FROM j WHERE a IS NOT NULL AND task_id NOT IN (SELECT task_id FROM m WHERE part)
UNION ALL SELECT task_id, 'old', b FROM j WHERE b IS NOT NULL AND task_id NOT IN (SELECT task_id FROM m WHERE part)""")
def partial_merge(spark, sf_dir):
    current, old = _halves(spark, sf_dir, True)
    now = F.lit("2024-03-01").cast("timestamp")
    current, old = lifecycle.merge_generations(current, old, now)
    return current.select("task_id", F.lit("current").alias("generation"), "status").unionByName(old.select("task_id", F.lit("old").alias("generation"), "status"))


# lifecycle


def _generations(spark, sf_dir) -> DataFrame:
    """Tasks of the session log with a generation and a date of deletion that follow from their ids."""
    t = _tasks(spark, sf_dir)
    day = F.split_part("task_id", F.lit("___"), F.lit(2)).cast("int")
    return t.withColumns({"generation": F.floor((day - 1) / 7).cast("int"), "date_to_delete": F.expr("make_timestamp(2024, 1, 1, 0, 0, 0)") + F.make_dt_interval(day + 3)})


_GEN = f"{FOLDED}, g AS (SELECT *, ((split_part(task_id, '___', 2)::INT - 1) // 7)::INT AS generation, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (split_part(task_id, '___', 2)::INT + 3) AS date_to_delete FROM t)"


@query(f"{_GEN} SELECT task_id FROM g WHERE NOT date_to_delete <= TIMESTAMP '{NOW}'")
def ttl_delete(spark, sf_dir):
    return lifecycle.delete_expired(_generations(spark, sf_dir), _now()).select("task_id")


@query(f"{_GEN} SELECT generation, count(*) AS expired FROM g WHERE date_to_delete <= TIMESTAMP '{NOW}' GROUP BY generation ORDER BY expired DESC, generation DESC LIMIT 2")
def expired_by_generation(spark, sf_dir):
    return lifecycle.expired_by_generation(_generations(spark, sf_dir), _now(), 2)


@query(f"""{_GEN} SELECT task_id, generation FROM g WHERE generation = 3 UNION ALL SELECT task_id, generation FROM g WHERE generation = 2 AND date_to_delete >= TIMESTAMP '{NOW}' AND task_id NOT IN (SELECT task_id FROM g WHERE generation = 3)""")
def compaction(spark, sf_dir):
    g = _generations(spark, sf_dir)
    return lifecycle.compact(g.filter("generation = 2"), g.filter("generation = 3"), _now()).select("task_id", "generation")


@query(f"""{_GEN}, a AS (SELECT generation, count(*) AS docs, sum(length(task_id))::BIGINT AS bytes, min(task_begin) AS b, max(task_begin) AS e FROM g GROUP BY generation)
SELECT generation, docs, bytes, (docs > 500 OR bytes > 20000 OR e - b > INTERVAL 7 DAY) AS rollover FROM a""")
def rollover_plan(spark, sf_dir):
    return lifecycle.rollover_plan(_generations(spark, sf_dir), 500, "7 days", F.length("task_id"), 20000).select("generation", "docs", "bytes", "rollover")


# reads


@query(f"{S} SELECT name, count(*) AS tasks FROM (SELECT task_id, arg_min(coalesce(name, id_name), seq) AS name FROM s GROUP BY task_id) q GROUP BY name ORDER BY tasks DESC, name LIMIT 20")
def count_by_name(spark, sf_dir):
    return lookup.top_counts(_tasks(spark, sf_dir), "name", 20).withColumnRenamed("count", "tasks")


_SOME = "task_id IN ('session_1___3', 'session_2___4', 'session_17___5', 'no_such_task')"


@query(f"{FOLDED} SELECT task_id, status FROM t WHERE {_SOME}")
def get_tasks_by_ids(spark, sf_dir):
    ids = spark.createDataFrame([("session_1___3",), ("session_2___4",), ("session_17___5",), ("no_such_task",)], "task_id string")
    return lookup.single_by_ids(_tasks(spark, sf_dir), ids).select("task_id", "status")


@query(f"{_BOTH} SELECT task_id, coalesce(a, b) AS status FROM j WHERE a IS NULL OR b IS NULL")
def duplicates_dropped(spark, sf_dir):
    """Two generations read together: ids that are in both give nothing."""
    first, second = _halves(spark, sf_dir)
    both = first.withColumn("generation", F.lit(1)).unionByName(second.withColumn("generation", F.lit(2)))
    return lookup.single_by_ids(both, both.select("task_id")).select("task_id", "status")


# plugins and telemetry

_RULES = '[{"class": "SwitchCase", "searchField": "message", "outputAttribute": "topic", "switch": [{"match": ["tion", "ción"], "output": "nominal"}, {"match": ["the ", "der "], "output": "article"}, {"output": "other"}]}]'


@query(f"SELECT seq, CASE WHEN contains(text, 'tion') OR contains(text, 'ción') THEN 'nominal' WHEN contains(text, 'the ') OR contains(text, 'der ') THEN 'article' ELSE 'other' END AS topic FROM ({logs.CONVERSATION_SQL}) c")
def switch_case_plugin(spark, sf_dir):
    events, _ = plugins.run_all(logs.conversation_log(spark, sf_dir), plugins.from_json(_RULES))
    return events.select("seq", F.col("strings")["topic"].alias("topic"))


@query(f"""SELECT task_id, CASE WHEN max(CASE WHEN type = 'SuccessEvent' THEN 1 ELSE 0 END) = 1 THEN 'SUCCESS' WHEN max(CASE WHEN type = 'ErrorEvent' THEN 1 ELSE 0 END) = 1 THEN 'ERROR' ELSE 'UNTERMINATED' END AS status,
arg_max(text, seq) AS message, arg_max(role, seq) AS role FROM ({logs.CONVERSATION_SQL}) c GROUP BY task_id""")
def conversation_tasks(spark, sf_dir):
    t = fold.fold(logs.conversation_log(spark, sf_dir), _now(), DAYS)
    return t.select("task_id", "status", F.col("text")["message"].alias("message"), F.col("string")["role"].alias("role"))


@query("SELECT event_type, (epoch_us(date_trunc('hour', ts)) // 1000) AS period_ms, count(*) AS amount, round(avg(value), 6) AS avg_value, max(value) AS max_value FROM events GROUP BY event_type, date_trunc('hour', ts)")
def heartbeat_window(spark, sf_dir):
    e = logs.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = telemetry.heartbeat_windows(e, "ts", "value", "1 hour", ["event_type"])
    return w.select("event_type", F.unix_millis("period_start").alias("period_ms"), "amount", F.round("avg_value", 6).alias("avg_value"), "max_value")


@query(f"{S} SELECT seq // 100 AS batch, count(*) AS events_amount, count(DISTINCT task_id) AS tasks_amount, count(DISTINCT parent_id) AS parents_amount, (epoch_us(max(time)) // 1000) - (epoch_us(min(time)) // 1000) AS duration FROM s GROUP BY seq // 100")
def batch_report(spark, sf_dir):
    e = logs.session_log(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 100))
    return telemetry.batch_report(e, "batch").drop("begin", "end")


@query("""WITH a AS (SELECT event_id AS item, i AS attempt, (event_id + i) % 5 = 0 AS ok, CASE WHEN event_id % 7 = 0 THEN 'index is missing' ELSE 'timeout' END AS message FROM events, (VALUES (1), (2), (3)) v(i) WHERE i <= 1 + event_id % 3)
SELECT item, max(attempt) AS attempts, CASE WHEN arg_max(ok, attempt) THEN 'done' WHEN arg_max(message, attempt) LIKE '%index is missing%' THEN 'dropped' WHEN max(attempt) >= 3 THEN 'persisted' ELSE 'retry' END AS state FROM a GROUP BY item""")
def dead_letter(spark, sf_dir):
    e = logs.table(spark, sf_dir, "events").select(F.col("event_id").alias("item"), F.explode(F.sequence(F.lit(1), (1 + F.col("event_id") % 3).cast("int"))).alias("attempt"))
    a = e.withColumns({"ok": (F.col("item") + F.col("attempt")) % 5 == 0, "message": F.when(F.col("item") % 7 == 0, "index is missing").otherwise("timeout")})
    return telemetry.dead_letters(a, ("null_pointer", "index is missing"))


@query(f"{S} SELECT seq, task_id, type, name, parent_id, (epoch_us(time) // 1000) AS time_ms, k::DOUBLE AS k FROM s")
def wire_round_trip(spark, sf_dir):
    """Events written as JSON envelopes of a hundred and parsed again."""
    e = logs.session_log(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 100))
    back = files.events_of(files.envelopes_from_text(files.to_envelopes(e, "batch")).withColumn("seq_base", F.col("id").cast("long")))
    rank = F.col("seq") % 1_000_000
    low = e.groupBy("batch").agg(F.min("seq").alias("low"))
    back = back.withColumn("batch", F.floor(F.col("seq") / 1_000_000)).join(low, "batch")
    return back.select((F.col("low") + rank).alias("seq"), "task_id", "type", "name", "parent_id", F.unix_millis("time").alias("time_ms"), F.col("metrics")["k"].alias("k"))
