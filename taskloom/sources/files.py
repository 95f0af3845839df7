"""Files: stored intermediate results, JSON envelopes, dead letters."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; only on one machine, without a setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut lineage that survives lost executors."""
    path = work_dir(df.sparkSession, tag)
    if (kept := getattr(_SCRATCH, "paths", None)) is not None:
        kept.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_bytes = bytes_of(df.sparkSession, [path])
    return out


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, and known to be none when a query is planned: what is joined with it costs no job."""
    return spark.range(1).filter("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


#: Bytes of Parquet files from which on a side of a join is not broadcast. Spark goes by file sizes, but rows in memory are ten times as large and more.
LARGE = 1 << 20


def bytes_of(spark: SparkSession, paths: list[str]) -> int:
    return sum(fs.getContentSummary(p).getLength() for fs, p in (_folder(spark, x) for x in paths))


def kept_apart(side: DataFrame, *tables: DataFrame) -> DataFrame:
    """``side`` of a join, made of no more than the stored ``tables``: where these are large, it is shuffled and does not pass through the driver."""
    return side.hint("merge") if sum(t.stored_bytes for t in tables) > LARGE else side


#: Where this thread's ``stored`` tables go that are to be deleted.
_SCRATCH = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What this thread stores inside is deleted at the end, so nothing that is read later may depend on it."""
    before, _SCRATCH.paths = getattr(_SCRATCH, "paths", None), []
    try:
        yield
    finally:
        paths, _SCRATCH.paths = _SCRATCH.paths, before
        for path in paths:
            fs, p = _folder(spark, path)
            fs.delete(p, True)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.mkdirs(p)


def numbers_of(spark: SparkSession, path: str, key: str) -> set[int]:
    """The numbers N of the complete folders ``key``=N below ``path``."""
    fs, p = _folder(spark, f"{path.rstrip('/')}/{key}=*/_SUCCESS")
    return {int(s.getPath().getParent().getName().partition("=")[2]) for s in fs.globStatus(p) or []}


_MAP = T.MapType(T.StringType(), T.StringType())
#: An event on the wire.
WIRE_EVENT = T.StructType(
    [T.StructField("@type", T.StringType()), T.StructField("taskId", T.StringType()), T.StructField("time", T.StringType()), T.StructField("name", T.StringType()), T.StructField("parentId", T.StringType()), T.StructField("status", T.StringType()), T.StructField("env", T.StringType()), T.StructField("primaryId", T.StringType()), T.StructField("parentsPath", T.ArrayType(T.StringType())), T.StructField("orphan", T.BooleanType()), T.StructField("dateToDelete", T.StringType()), T.StructField("strings", _MAP), T.StructField("text", _MAP), T.StructField("context", _MAP), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))]
)
_ENVELOPE = T.StructType([T.StructField("id", T.StringType()), T.StructField("events", T.ArrayType(WIRE_EVENT)), T.StructField("_corrupt", T.StringType())])


#: Events of an envelope: so many numbers in a row are kept for each.
MOST_EVENTS = 1_000_000


def envelopes_from_text(lines: DataFrame) -> DataFrame:
    """id, events, malformed (the line, if it is no envelope) from a column ``value`` of JSON: {"id", "events"} or a bare list.

    One with more than ``MOST_EVENTS`` events is malformed, too."""
    bare = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.concat(F.lit('{"events":'), "value", F.lit("}"))).otherwise(F.col("value"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "true"}
    # an explode of one element, as filters that come later are not pushed below it: in them each use would parse the line once more
    parsed = lines.select("*", F.explode_outer(F.array(F.from_json(bare, _ENVELOPE, options))).alias("e"))
    bad = F.col("e._corrupt").isNotNull() | F.col("e.events").isNull() | (F.size("e.events") > MOST_EVENTS)
    return parsed.select(*[c for c in lines.columns if c != "value"], F.col("e.id").alias("id"), F.when(~bad, F.col("e.events")).alias("events"), F.when(bad, F.col("value")).alias("malformed"))


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Envelopes, one per line, plain or gzip, from files below ``path``, with file and place for the arrival order."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").load(path)
    return envelopes_from_text(lines.select("value", F.col("_metadata.file_modification_time").alias("received"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def events_of(envelopes: DataFrame, base: str = "seq_base") -> DataFrame:
    """Events (model.EVENT) of well-formed envelopes; ``seq`` is the envelope's number times a million and the place in it."""
    e = envelopes.filter("malformed IS NULL").select(F.col(base).alias("_base"), F.posexplode("events").alias("_at", "e"))
    stamp = lambda c: F.to_timestamp(F.col(f"e.{c}"))
    return e.select(
        F.col("e.@type").alias("type"), F.col("e.taskId").alias("task_id"), (F.col("_base") * MOST_EVENTS + F.col("_at")).cast("long").alias("seq"), stamp("time").alias("time"), "e.name", F.col("e.parentId").alias("parent_id"), "e.status", "e.env",
        F.col("e.primaryId").alias("primary_id"), F.col("e.parentsPath").alias("parents_path"), "e.orphan", stamp("dateToDelete").alias("date_to_delete"), "e.strings", "e.text", "e.context", "e.metrics",
    )


def to_envelopes(events: DataFrame, id_of: str | None = None) -> DataFrame:
    """``value``: one JSON envelope per batch column ``id_of``, or per event, for ``write.text``."""
    wire = F.struct(
        F.col("type").alias("@type"), F.col("task_id").alias("taskId"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time"), "name", F.col("parent_id").alias("parentId"), "status", "env", F.col("primary_id").alias("primaryId"),
        F.col("parents_path").alias("parentsPath"), "orphan", F.date_format("date_to_delete", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("dateToDelete"), "strings", "text", "context", "metrics",
    )
    rows = events.select(F.col(id_of).cast("string").alias("id") if id_of else F.uuid().alias("id"), "seq", wire.alias("e"))
    batches = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "e")), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("es"))
    return batches.select(F.to_json(F.struct(F.lit("EventsWrapper").alias("@type"), "id", F.transform("es", lambda x: x["e"]).alias("events"))).alias("value"))
