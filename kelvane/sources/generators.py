"""Random sparse matrices, made by hashing cell numbers: the same seed gives the same matrix on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from .storage import store

PATTERNS = ("random", "block_diagonal", "random_blocks", "banded")


def _unit(*keys: Column) -> Column:
    """A number in (0, 1] from a hash."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**31 - 1)) + 1) / float(2**31 - 1)


def _cells(spark: SparkSession, rows: int, cols: int, density: float, seed: int) -> DataFrame:
    """Exactly round(density * rows * cols) distinct cells: the draws with the least hashes."""
    size = rows * cols
    k = min(size, round(density * size))
    if k * 3 >= size:
        drawn = spark.range(size).select(F.col("id").alias("cell"))
    else:  # enough draws that their distinct cells surely suffice
        draws = int(k * (1 + k / size) + 10 * math.sqrt(k) + 20) * 2
        drawn = spark.range(draws).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)).alias("cell")).distinct()
    chosen = least(drawn.withColumn("h", F.xxhash64(F.lit(seed + 1), "cell")), k, "h", "cell")
    return chosen.select(F.floor(F.col("cell") / cols).cast("long").alias("row"), F.pmod("cell", F.lit(cols)).alias("col"))


def least(rows: DataFrame, k: int, hash_: str, tie: str) -> DataFrame:
    """The k rows of the least hashes (64 bits): all below a slice of 1/65536 of the hashes, and of that slice the first ones."""
    rows = store(rows.withColumn("slice", F.shiftright(hash_, 48)), "draws")
    below, edge = 0, None
    for r in rows.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect():  # 65536 rows at most
        if below + r["n"] >= k:
            edge = r["slice"]
            break
        below += r["n"]
    if edge is None:
        return rows.drop("slice")
    rest = rows.where(F.col("slice") == edge).orderBy(hash_, tie).limit(k - below)
    return rows.where(F.col("slice") < edge).unionByName(rest).drop("slice")


def generate(spark: SparkSession, rows: int, cols: int, density: float, pattern: str = "random", block: int = 10, seed: int = 42) -> SparseMatrix:
    """random: uniform cells. block_diagonal: blocks of twice the density. random_blocks: full blocks, a later one wins.
    banded: all diagonals up to the root of the number of cells asked for. A matrix never is empty."""
    value = _unit(F.lit(seed + 2), F.col("row"), F.col("col"))
    if pattern == "random":
        cells = _cells(spark, rows, cols, density, seed).withColumn("val", value)
    elif pattern == "block_diagonal":
        n = max(1, min(rows // block, cols // block))
        per = _cells(spark, block * n, block, min(1.0, density * 2), seed)
        cells = per.select("row", (F.floor(F.col("row") / block) * block + F.col("col")).cast("long").alias("col")).withColumn("val", value)
        rows, cols = min(rows, n * block), min(cols, n * block)
        cells = cells.where((F.col("row") < rows) & (F.col("col") < cols))
    elif pattern == "random_blocks":
        n = int(density * rows * cols / block**2)
        at = lambda salt, size: F.pmod(F.xxhash64(F.lit(seed + salt), "id"), F.lit(max(1, size - block)))
        starts = spark.range(n).select("id", at(3, rows).alias("r"), at(4, cols).alias("c"))
        each = starts.select("id", F.explode(F.sequence("r", F.col("r") + (block - 1))).alias("row"), "c").select("id", "row", F.explode(F.sequence("c", F.col("c") + (block - 1))).alias("col"))
        each = each.where((F.col("row") < rows) & (F.col("col") < cols)).withColumn("val", _unit(F.lit(seed + 2), F.col("id"), F.col("row"), F.col("col")))
        cells = each.groupBy("row", "col").agg(F.max_by("val", "id").alias("val"))
    elif pattern == "banded":
        half = max(1, int(math.sqrt(density * rows * cols)))
        cells = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("id") - half), F.least(F.lit(cols - 1).cast("long"), F.col("id") + half))).alias("col")).withColumn("val", value)
    else:
        raise ValueError(f"unknown pattern {pattern}; one of {', '.join(PATTERNS)}")
    if cells.isEmpty():
        cells = spark.range(min(rows, cols)).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))
    return SparseMatrix(cells, rows, cols, pattern)
