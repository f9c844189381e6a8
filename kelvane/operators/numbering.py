"""Row numbers and running sums over a whole table without putting it into one partition.

The table is dealt by ranges of the keys, so that the partitions follow one another and each one is numbered by itself; what
lies before a partition is one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import store

#: Bits of Spark's increasing ids that tell the place within a partition.
PLACE_BITS = 33


def _dealt(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` with __part and __place: both ascend with the keys."""
    at = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at)
    # Written, so that every later step sees one and the same deal.
    return store(sorted_.withColumns({"__part": F.shiftright("__at", PLACE_BITS), "__place": F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1)}).drop("__at"), "ranges")


def _before(parts: DataFrame, value: str) -> DataFrame:
    """(__part, __before): parts has one row a partition."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("__before"))


def numbered(rows: DataFrame, *keys: str | Column, name: str = "number") -> DataFrame:
    """``rows`` plus their number from 0 in the order of the keys, which must tell all rows apart."""
    dealt = _dealt(rows, [F.col(k) if isinstance(k, str) else k for k in keys])
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    return dealt.join(F.broadcast(_before(sizes, "__n")), "__part").withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before")


def running(rows: DataFrame, value: str, *keys: str | Column, name: str = "sum") -> DataFrame:
    """``rows`` plus the sum of ``value`` over the rows up to and with each one in the order of the keys."""
    dealt = _dealt(rows, [F.col(k) if isinstance(k, str) else k for k in keys])
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__n"))
    within = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("__own", F.sum(value).over(within))
    return own.join(F.broadcast(_before(sums, "__n")), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__place", "__before", "__own")
