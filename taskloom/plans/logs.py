"""Event logs derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .. import model as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event(**cols) -> list:
    """Columns of model.EVENT, null where not given."""
    return [cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.EVENT]


def by(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per user and day; signups start, purchases succeed, errors fail it; parents are the day before."""
    e = table(spark, sf_dir, "events")
    day, user = F.day("ts"), F.col("user_id")
    task = lambda d: F.concat(F.lit("session_"), user.cast("string"), F.lit("___"), d.cast("string"))
    signup = F.col("event_type") == "signup"
    kind = F.when(signup, M.START).when(F.col("event_type") == "purchase", M.SUCCESS_EVENT).when(F.col("event_type") == "error", M.ERROR_EVENT).otherwise(M.INFO)
    return e.select(
        *_event(
            seq=F.col("event_id"), time=F.col("ts").cast("timestamp"), task_id=task(day), type=kind, name=F.when(signup, F.concat(F.lit("session_"), user.cast("string"))),
            parent_id=F.when(signup & (day > 1) & ((user + day) % 7 != 0), task(day - 1)), env=F.lit("default"),
            context=F.create_map(F.lit("last_type"), F.col("event_type")), metrics=F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1).cast("double")),
            strings=F.create_map(F.lit("kind"), F.col("event_type")), text=F.create_map(F.lit("props"), F.col("props")),
        )
    )


SESSION_SQL = """
SELECT event_id AS seq, ts AS time, concat('session_', user_id::VARCHAR, '___', day(ts)::VARCHAR) AS task_id,
  CASE event_type WHEN 'signup' THEN 'StartEvent' WHEN 'purchase' THEN 'SuccessEvent' WHEN 'error' THEN 'ErrorEvent' ELSE 'InfoEvent' END AS type,
  CASE WHEN event_type = 'signup' THEN concat('session_', user_id::VARCHAR) END AS name,
  CASE WHEN event_type = 'signup' AND day(ts) > 1 AND (user_id + day(ts)) % 7 <> 0 THEN concat('session_', user_id::VARCHAR, '___', (day(ts) - 1)::VARCHAR) END AS parent_id,
  event_type, value, regexp_extract(props, '([0-9]+)', 1)::INT AS k, props, concat('session_', user_id::VARCHAR) AS id_name
FROM events"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, parent_id, name, ctx: regions, nations, customers and orders, some nations and customers missing."""
    t = lambda n: table(spark, sf_dir, n)
    s = lambda c: F.col(c).cast("string")
    one = lambda df, pre, key, up_pre, up, name, k, v: df.select(F.concat(F.lit(pre + "___"), s(key)).alias("task_id"), (F.concat(F.lit(up_pre + "___"), s(up)) if up else F.lit(None).cast("string")).alias("parent_id"), name.alias("name"), F.create_map(k, v).alias("ctx"))
    region = one(t("region"), "region", "r_regionkey", None, None, F.col("r_name"), F.lit("region"), F.col("r_name"))
    nation = one(t("nation").filter("n_nationkey % 12 != 11"), "nation", "n_nationkey", "region", "n_regionkey", F.col("n_name"), F.lit("nation"), F.col("n_name"))
    customer = one(t("customer").filter("c_custkey % 13 != 0"), "customer", "c_custkey", "nation", "c_nationkey", F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    key = F.when(F.col("o_orderkey") % 5 == 0, "region").otherwise("priority")
    order = one(t("orders"), "order", "o_orderkey", "customer", "o_custkey", F.concat(F.lit("order_"), F.col("o_orderstatus")), key, F.col("o_orderpriority"))
    return region.unionByName(nation).unionByName(customer).unionByName(order)


TREE_SQL = """
SELECT concat('region___', r_regionkey::VARCHAR) AS task_id, NULL::VARCHAR AS parent_id, r_name AS name, 'region' AS ctx_key, r_name AS ctx_value FROM region
UNION ALL SELECT concat('nation___', n_nationkey::VARCHAR), concat('region___', n_regionkey::VARCHAR), n_name, 'nation', n_name FROM nation WHERE n_nationkey % 12 <> 11
UNION ALL SELECT concat('customer___', c_custkey::VARCHAR), concat('nation___', c_nationkey::VARCHAR), c_name, 'segment', c_mktsegment FROM customer WHERE c_custkey % 13 <> 0
UNION ALL SELECT concat('order___', o_orderkey::VARCHAR), concat('customer___', o_custkey::VARCHAR), concat('order_', o_orderstatus),
  CASE WHEN o_orderkey % 5 = 0 THEN 'region' ELSE 'priority' END, o_orderpriority FROM orders"""


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per conversation: its first turn starts it, its last one ends it, well if the assistant speaks."""
    c = table(spark, sf_dir, "conversations")
    ends = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    j = c.join(ends, "conv_id")
    first, last = F.col("turn") == F.col("first"), F.col("turn") == F.col("last")
    kind = F.when(first, M.START).when(last & (F.col("role") == "assistant"), M.SUCCESS_EVENT).when(last, M.ERROR_EVENT).otherwise(M.INFO)
    return j.select(
        *_event(
            seq=F.col("conv_id") * 1000 + F.col("turn"), time=F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")), task_id=F.concat(F.lit("conversation___"), F.col("conv_id").cast("string")), type=kind,
            name=F.when(first, F.lit("conversation")), env=F.lit("default"), text=F.create_map(F.lit("message"), F.col("text")), strings=F.create_map(F.lit("role"), F.col("role")),
        )
    )


CONVERSATION_SQL = """
SELECT concat('conversation___', conv_id::VARCHAR) AS task_id, conv_id * 1000 + turn AS seq, role, text,
  CASE WHEN turn = first THEN 'StartEvent' WHEN turn = last AND role = 'assistant' THEN 'SuccessEvent' WHEN turn = last THEN 'ErrorEvent' ELSE 'InfoEvent' END AS type
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) q"""
