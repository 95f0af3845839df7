"""What micro-batches have to know of those before them, as small tables in the stream's checkpoint folder.

Rows lie by the hour of file time they came with and by micro-batch. A micro-batch sees the rows of those before it, so one that
is replayed sees what it saw the first time, and writes its own rows anew in place of themselves. Hours that lie further back
than a stated span are deleted, so the table follows the span and not the length of the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hour_of(received: Column) -> Column:
    return F.floor(F.unix_micros(received) / 3_600_000_000).cast("long")


class Recent:
    def __init__(self, spark: SparkSession, path: str, columns: str, hours: int):
        """``columns`` as a schema; ``hours``: the span that is kept."""
        self.spark, self.path, self.span = spark, path.rstrip("/"), hours
        self.schema = f"{columns}, hour long, batch long"
        self.columns = spark.createDataFrame([], columns).columns
        fs, p = self._fs("")
        fs.mkdirs(p)

    def _fs(self, below: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}".rstrip("/"))
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _hours(self, number: int) -> set[int]:
        fs, p = self._fs("hour=*/batch=*")
        names = [s.getPath().toString().split("/")[-2:] for s in fs.globStatus(p) or []]
        return {int(h.partition("=")[2]) for h, b in names if int(b.partition("=")[2]) < number}

    def horizon(self, number: int) -> int | None:
        """The first hour that a micro-batch still knows of, None if none came before."""
        return max(hours) - self.span if (hours := self._hours(number)) else None

    def before(self, number: int) -> DataFrame:
        """Rows of the micro-batches before ``number``, from the horizon on."""
        rows = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("batch") < number)
        if (first := self.horizon(number)) is not None:
            rows = rows.filter(F.col("hour") >= first)
        return rows.select(*self.columns)

    def put(self, rows: DataFrame, hour: Column, number: int) -> None:
        rows = rows.select(*self.columns, hour.cast("long").alias("hour"), F.lit(number).cast("long").alias("batch"))
        # a file an hour, more of them for hours that bring much: a stream that catches up has all its files in one hour
        rows.hint("rebalance", F.col("hour")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(self.path)

    def expire(self, number: int) -> list[int]:
        """Delete the hours that no micro-batch from ``number`` on looks at."""
        first = self.horizon(number)
        gone = sorted(h for h in self._hours(number) if first is not None and h < first)
        for h in gone:
            fs, p = self._fs(f"hour={h}")
            fs.delete(p, True)
        return gone
