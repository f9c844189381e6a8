"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None
#: Tables written so far by the innermost :func:`settle`.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may fall back to a temporary folder of its own.
    """
    global _own_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="kelvane-")
    return _own_root


#: Whether shuffle files go with the end of the action that made them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of what is written within go once it is written; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kelvane_path = path
    if (written := _written.get()) is not None:
        written.append(out)
    return out


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """:func:`materialise` what ``make()`` returns, and delete all that it wrote on the way; if it fails, that goes as well."""
    made: list[DataFrame] = []
    token = _written.set(made)
    try:
        df = make()
        _written.reset(token)
        return materialise(df, name)
    except BaseException:
        if _written.get() is made:
            _written.reset(token)
        raise
    finally:
        for used in made:
            discard(used)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote, once nothing will read it again."""
    path = getattr(df, "_kelvane_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores behind it while ``df`` has such a column (in any case): for added and working columns."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def lower_ascii(c):
    """Lower-case A-Z only, so that the result does not depend on a locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
