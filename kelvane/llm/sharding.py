"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass 1 scatters the records by seeded hashes: the key alone picks the shard (highest hash of key and shard
number wins, so one more shard takes rows only into itself), and a hash of the whole record picks one of the
shard's buckets. The number of buckets follows from the bytes, so that a bucket fits in a task's memory.
Pass 2 takes a bucket a task, shuffles it by Fisher-Yates (Spark's ``shuffle`` with a seed, over the sorted
bucket, so that a task that runs again gives the same order) and numbers the rows of a shard without gaps. The
records themselves travel, and are written as a folder a shard.

Defined cases: equal records (found by a hash, told apart by their columns) are first counted, then dealt apart
by copy number, so that no flood of equal rows fills one bucket; null keys are one key; columns are carried along as they are, and an added column whose
name is taken gets an underscore behind it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, materialise, shared_root, table

N_SHARDS = 16
SEED = 20240611
#: Bytes of records that a bucket should hold.
BUCKET_BYTES = 32 << 20
#: Bytes that a record takes in a bucket besides its text.
RECORD_BYTES = 64
#: Hashes of repeated records up to which they are broadcast (8 bytes each); beyond, all records are counted by shuffle.
BROADCAST_PRINTS = 2_000_000


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of (key, shard) is highest."""
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("h"), F.lit(k).alias("k")) for k in range(n_shards)])
    return best["k"]


def _counted(records: DataFrame, key: str, weight: Column) -> DataFrame:
    """record, key, bytes, n: the distinct records and how often each stands. Only repeated ones are dealt out for it."""
    # The record travels as one column, so that no name of its own meets one of ours.
    keyed = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"), F.col(key).alias("key"), weight.cast("long").alias("bytes"))
    count = lambda rows: materialise(rows.groupBy("record", "key", "bytes").agg(F.count("*").alias("n")), "counted")
    marked = keyed.withColumn("print", F.xxhash64("record"))
    prints = materialise(marked.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "prints")
    if prints.count() > BROADCAST_PRINTS:
        return count(keyed)
    once = marked.join(F.broadcast(prints), "print", "left_anti").select("record", "key", "bytes", F.lit(1).cast("long").alias("n"))
    return once.unionByName(count(marked.join(F.broadcast(prints), "print", "left_semi")))


def shuffle_shards(records: DataFrame, key: str, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, size: str | Column | None = None) -> DataFrame:
    """``records`` plus ``shard``, ``grown_shard`` (with one more shard), ``bucket`` and ``slot``.

    ``size`` tells the bytes of the record as it is carried; without it RECORD_BYTES count. A bucket is in one task.
    """
    spark = records.sparkSession
    weight = F.lit(RECORD_BYTES) if size is None else F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)) + RECORD_BYTES
    copies = _counted(records, key, weight).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    placing = {"shard": shard_of(F.col("key"), n_shards, seed), "grown_shard": shard_of(F.col("key"), n_shards + 1, seed), "deal": F.xxhash64(F.lit(seed + 1), "record", "copy")}
    scattered = copies.withColumns(placing).select("record", "bytes", "copy", *placing)
    # Each shard has the buckets that its own bytes ask for: a key may hold a third of all rows.
    per_shard, first = [], 0
    for r in scattered.groupBy("shard").agg(F.ceil(F.sum("bytes") / bucket_bytes).cast("int").alias("buckets")).orderBy("shard").collect():  # a row a shard
        per_shard.append((r["shard"], r["buckets"], first))
        first += r["buckets"]
    table_of = F.broadcast(spark.createDataFrame(per_shard, "shard int, buckets int, first int"))
    dealt = scattered.join(table_of, "shard").withColumn("bucket", F.pmod("deal", "buckets").cast("int")).withColumn("place", F.col("first") + F.col("bucket"))
    sizes = dealt.groupBy("shard", "bucket", "place").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", "bucket", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a bucket
    row = F.struct("deal", "copy", "grown_shard", "record")
    buckets = dealt.select("place", row.alias("row")).repartitionById(max(1, first), F.col("place")).groupBy("place").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    shuffled = buckets.select("place", F.posexplode(F.shuffle("rows", F.lit(seed + 2))).alias("pos", "row"))
    placed = shuffled.join(F.broadcast(base), "place")
    added = {"shard": F.col("shard"), "grown_shard": F.col("row.grown_shard"), "bucket": F.col("bucket"), "slot": (F.col("base") + F.col("pos")).cast("long")}
    return placed.select(*[F.col("row.record")[c].alias(c) for c in records.columns], *[v.alias(free_name(records, k)) for k, v in added.items()])


def write_shards(placed: DataFrame, path: str) -> None:
    """Write one folder per shard, each bucket in slot order; ``placed`` as :func:`shuffle_shards` gives it, a bucket in one task."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    placed = shuffle_shards(table(spark, sf_dir, "documents"), "doc_id", size=F.octet_length("text"))
    path = f"{shared_root(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(placed, path)
    written = spark.read.schema(placed.schema).parquet(path)
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    return written.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
