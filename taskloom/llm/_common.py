"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and their small letters; no other letter is touched.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The white space that separates words, as code points and as a class of a regular expression.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Where rows without an id stand when ids are compared: after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, which may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names no folder, as in tests on one machine, one is made for it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, batch: str = "8m", **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs start from the files,
    whichever executors are lost, and nothing is computed twice. ``batch``: bytes of rows that go to Python at a time."""
    spark = df.sparkSession
    path = work_dir(spark, tag)
    with small_batches(spark, batch):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Empty tables that ``stored`` has written, once no result that is still to be computed reads them."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(t.stored_at)


def give_back() -> None:
    """Memory that this Python worker has freed goes back to the machine, of Arrow's and of the C library's."""
    import pyarrow  # here, as native operators import this module

    pyarrow.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """While this holds, rows go to Python in batches of so many bytes, whatever the lengths of texts; then the session's own setting is back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key with over one in so many rows is hot; so there are fewer hot keys than this, whatever the data.
HOT = 1000


#: Rows that may meet in one task whatever their keys are.
FEW_ROWS = 20_000


def join_owners(rows: DataFrame, owners: DataFrame, keys: list[str], n: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """``rows`` joined to ``owners`` (one row per key, with the key's number of rows in ``n``, which is left out) on ``keys``.

    ``most`` is the number of rows, if it is known: ``FEW_ROWS`` are joined plainly. Else rows of a hot key are dealt out to as many slices as it takes, and its owner stands in each. Hot keys are broadcast: fewer than
    ``HOT`` by what hot means. ``owners`` is stored first.

    A row's slice goes by a hash of all its columns but maps, so a task that runs again, over rows in another order, deals them out as
    before. Rows that agree in all of that share a slice; Spark may split it, as neither side is aggregated after its exchange."""
    if most is not None and most <= FEW_ROWS:
        return rows.join(owners.drop(n), keys, how)
    owners = stored(owners, "owners")
    total = owners.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(owners.filter(F.col(n) * HOT > total).select(*keys, F.ceil(F.col(n) * HOT / F.lit(max(total, 1))).cast("int").alias("__slices")))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()])
    dealt = rows.join(hot, keys, "left").withColumn("__slice", F.when(F.col("__slices").isNull(), 0).otherwise(F.pmod(whole, F.col("__slices"))).cast("int")).drop("__slices")
    each = owners.join(hot, keys, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1))).drop("__slices", n)
    return dealt.join(each, [*keys, "__slice"], how).drop("__slice")


#: Tables that modules keep in a Python worker from task to task, by name.
WORKER_TABLES: dict[str, dict] = {}


_owner = ""


def claim_worker(own: str = "") -> None:
    """At the start of a task in Python: when the last task in this worker was another operator's, drop the tables that it
    has kept and give freed memory back. Spark uses workers again, and freed memory else stays with them."""
    if own != _owner:
        leave_worker(own)


def leave_worker(to: str = "") -> None:
    """Drop the tables of all operators but ``to`` and give freed memory back. At a task's end, so that workers hold none while they rest: Spark
    keeps more of them than run at a time, takes them in turn, and lets those that no task needs rest as long as others work."""
    global _owner
    _owner = to
    for name, t in WORKER_TABLES.items():
        if name != to:
            t.clear()
    gc.enable()
    gc.collect()
    give_back()


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many more underscores before it as it takes to be no column's name (in any case of letters)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
