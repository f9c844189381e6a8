"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_own: str | None = None

#: A row of numbers takes so many times the bytes in memory that it takes in a file. Spark takes a table's files for its size, and would
#: send tables of up to 10 MB of them, which are many times that in the driver, to all tasks.
UNPACKED, _FACTOR = 16, "spark.sql.sources.fileCompressionFactor"


def root(spark) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets a temporary folder.

    A session that has not set spark.sql.sources.fileCompressionFactor takes it from ``UNPACKED``.
    """
    global _own
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, str(float(UNPACKED)))
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="kelvane-")
    return _own


#: Whether shuffle files go with the end of the action that made them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark):
    """Shuffle files of what is written within go once it is written; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write and read again, so that loops do not grow a lineage."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """Write dealt by ``keys`` into buckets, sorted within each, and read again: joins and aggregations by the keys need no exchange of it.

    Each task would write a file a bucket; rows are dealt by the buckets' own hash first, so there is one file a bucket.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{root(spark)}/{table}"
    dealt = df.repartition(buckets, *keys)
    with swept(spark):
        dealt.write.bucketBy(buckets, *keys).sortBy(*(sort or keys)).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stored_at, out._table = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`store` wrote, once no plan reads it any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            if hasattr(df, "_table"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


class Growing:
    """A table that a loop appends to: each round writes its own rows only."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema = first.sparkSession, StructType(first.schema.fields)
        self.path = f"{root(self.spark)}/{name}-{uuid.uuid4().hex}"
        with swept(self.spark):
            first.write.parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        with swept(self.spark):
            rows.select(*self.schema.names).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).parquet(self.path)
        out._stored_at = self.path
        return out
