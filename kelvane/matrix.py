"""Sparse matrices as coordinate DataFrames with a shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.storage import bucketed, store


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (row, col, val), one per cell, 0-based; empty rows and columns exist in the shape only."""

    entries: DataFrame
    nrows: int
    ncols: int
    name: str = "matrix"

    @classmethod
    def of(cls, cells: DataFrame, nrows: int, ncols: int, name: str = "matrix") -> "SparseMatrix":
        """From cells that may repeat: repeated ones are added up."""
        return cls(cells.groupBy("row", "col").agg(F.sum("val").alias("val")), nrows, ncols, name)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    @property
    def square(self) -> bool:
        return self.nrows == self.ncols

    def stored(self) -> "SparseMatrix":
        """The same with its entries written once, for what reads them more than once."""
        return self if hasattr(self.entries, "_stored_at") else SparseMatrix(store(self.entries, "entries"), self.nrows, self.ncols, self.name)

    def transpose(self) -> "SparseMatrix":
        return SparseMatrix(self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.ncols, self.nrows, self.name)

    def slice(self, rows: tuple[int, int], cols: tuple[int, int]) -> "SparseMatrix":
        """Rows and columns of half-open ranges, renumbered from 0; the ranges reach the scan as predicates."""
        (r0, r1), (c0, c1) = rows, cols
        part = self.entries.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
        return SparseMatrix(part.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "val"), r1 - r0, c1 - c0, self.name)

    def gather(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> "SparseMatrix":
        """Permute by (new_pos, old_id) tables of the rows, the columns, or both."""
        out = self.entries
        for axis, perm in (("row", rows), ("col", cols)):
            if perm is not None:
                p = perm.select(F.col("new_pos").alias("__new"), F.col("old_id").alias(axis))
                out = out.join(p, axis).withColumn(axis, F.col("__new")).select("row", "col", "val")
        return SparseMatrix(out, self.nrows, self.ncols, self.name)

    def add(self, other: "SparseMatrix") -> "SparseMatrix":
        if (self.nrows, self.ncols) != (other.nrows, other.ncols):
            raise ValueError("shapes differ")
        return SparseMatrix.of(self.entries.unionByName(other.entries), self.nrows, self.ncols, self.name)

    def layout(self, by: str = "row") -> DataFrame:
        """Entries ordered by row (or column) across partitions: the cluster's form of compressed rows or columns."""
        keys = [by, "col" if by == "row" else "row"]
        return self.entries.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def bucketed(self, by: str = "col", buckets: int | None = None) -> "SparseMatrix":
        """The same with its entries in a table of sorted buckets by row or column, which joins by that key do not shuffle."""
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [by, "col" if by == "row" else "row"]
        return SparseMatrix(bucketed(self.entries, "entries", [by], buckets, keys), self.nrows, self.ncols, self.name)

    def row_ids(self) -> DataFrame:
        return self.spark.range(self.nrows).withColumnRenamed("id", "row")


def identity(ids: DataFrame, key: str) -> DataFrame:
    return ids.select(F.col(key).alias("new_pos"), F.col(key).alias("old_id"))
