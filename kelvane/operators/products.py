"""Sparse products: matrix by vector, matrix by matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.storage import bucketed, store
from . import meeting

#: Entries of a vector up to which it is broadcast (16 bytes each).
BROADCAST_ENTRIES = 4_000_000


def _complete(m: SparseMatrix, y: DataFrame) -> DataFrame:
    return m.row_ids().join(y, "row", "left").select(F.col("row").alias("idx"), F.coalesce("val", F.lit(0.0)).alias("val"))


def check_length(m: SparseMatrix, x: DataFrame) -> None:
    """A vector must have exactly one entry per column."""
    n, lo, hi = x.agg(F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()
    if n != m.ncols or (n and (lo != 0 or hi != m.ncols - 1)):
        raise ValueError(f"the vector has {n} entries, the matrix {m.ncols} columns")


def spmv(m: SparseMatrix, x: DataFrame, strategy: str = "shuffle", block: int = 1024) -> DataFrame:
    """y = A x as (idx, val), for every row; a vector that does not have one entry per column is refused.

    shuffle: a sort-merge join on the column and an aggregation by row, any size. broadcast: the same with the vector
    sent to all tasks, if its length allows. blocked: rows of a block meet in one task, which adds them by NumPy.
    """
    if strategy not in ("shuffle", "broadcast", "blocked"):
        raise ValueError(f"unknown strategy {strategy}")
    check_length(m, x)
    v = x.select(F.col("idx").alias("col"), F.col("val").alias("x"))
    small = strategy == "broadcast" and m.ncols <= BROADCAST_ENTRIES
    joined = m.entries.join(F.broadcast(v) if small else v.hint("merge"), "col").select("row", (F.col("val") * F.col("x")).alias("p"))
    if strategy != "blocked":
        return _complete(m, joined.groupBy("row").agg(F.sum("p").alias("val")))

    def add(batches):
        for b in batches:
            row, p = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, at = np.unique(row, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, p, len(ids)))], names=["row", "val"])

    dealt = joined.repartition(F.floor(F.col("row") / block)).sortWithinPartitions("row")
    partial = dealt.mapInArrow(add, "row long, val double")  # a row may be cut by a batch
    return _complete(m, partial.groupBy("row").agg(F.sum("val").alias("val")))


#: Columns of a packed block, and its entries a column.
PACKED, PACKED_DEPTH = 1024, 16


def packed(m: SparseMatrix, block: int = PACKED) -> DataFrame:
    """(cb, rows, cols, vals): blocks of ``block`` columns, with rows by number and columns by place in the block; bucketed by block of columns.

    A block's rows are dealt by hash to pieces of about ``PACKED_DEPTH`` entries a column, a row of the table each: however sparse
    the matrix, a piece has more entries than the vector's part that is sent to it. The layout for a matrix that is multiplied
    again and again: a product reads it where it lies, and shuffles the vector only.
    """
    m = m.stored()
    cells = m.entries.select("row", F.floor(F.col("col") / block).cast("long").alias("cb"), F.pmod("col", F.lit(block)).cast("int").alias("col"), F.col("val").cast("double").alias("val"))
    pieces = cells.groupBy("cb").agg(F.ceil(F.count("*") / (PACKED_DEPTH * block)).alias("pieces"))
    dealt = cells.join(pieces, "cb").withColumn("piece", F.pmod(F.xxhash64("row"), "pieces"))
    blocks = dealt.groupBy("cb", "piece").agg(F.array_sort(F.collect_list(F.struct("row", "col", "val"))).alias("e"))
    table = blocks.select("cb", *[F.col(f"e.{c}").alias(f"{c}s") for c in ("row", "col", "val")])
    return bucketed(table, "packed", ["cb"], int(m.spark.conf.get("spark.sql.shuffle.partitions")))


def spmv_packed(blocks: DataFrame, m: SparseMatrix, x: DataFrame, block: int = PACKED) -> DataFrame:
    """y = A x as (idx, val) of the packed blocks of ``m``: a block meets its piece of the vector, and NumPy multiplies them."""
    check_length(m, x)
    piece = F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda v: v["val"])
    vector = x.groupBy(F.floor(F.col("idx") / block).cast("long").alias("cb")).agg(piece.alias("x"))

    def multiply(batches):
        for b in batches:
            for k in range(b.num_rows):
                row, col, val, v = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
                ids, at = np.unique(row, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, val * v[col], len(ids)))], names=["row", "val"])

    met = blocks.join(vector.hint("merge"), "cb").select("rows", "cols", "vals", "x")
    return _complete(m, met.mapInArrow(multiply, "row long, val double").groupBy("row").agg(F.sum("val").alias("val")))


def spgemm(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """Cells that meet at an inner index are multiplied, and added up by the task that has their row (:mod:`meeting`)."""
    if a.ncols != b.nrows:
        raise ValueError("inner sizes differ")
    left = a.stored().entries.select(F.col("col").alias("k"), "row", F.col("val").alias("l"))
    right = b.stored().entries.select(F.col("row").alias("k"), "col", F.col("val").alias("r"))
    sizes = store(meeting.sizes(left).join(meeting.sizes(right).withColumnRenamed("a", "b"), "k"), "sizes")
    cells = meeting.pairs(left, right, sizes).groupBy("row", "col").agg(F.sum(F.col("l") * F.col("r")).alias("val"))
    return SparseMatrix(cells, a.nrows, b.ncols, a.name)


#: Entries of a block of rows, two of which a task multiplies.
GRAM_CELLS = 1_000_000


def _multiplied(batches):
    """Over pairs (i, j) of blocks: the cells of the product of the one and the other's transpose, both ways if they are two."""
    names = ["ids", "row_n", "row_cols", "row_vals", "ids", "cols", "col_n", "col_rows", "col_vals"]
    for batch in batches:
        same = [a == b for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        for one, (ids, row_n, row_cols, row_vals, others, cols, col_n, col_rows, col_vals) in zip(same, meeting.arrays(batch.select(batch.schema.names[2:]), names), strict=True):
            for first, _, cell, there, row in meeting.expanded(row_n, row_cols, cols, col_n, 1, 1_000_000):
                if not len(cell):
                    continue
                key = row * len(others) + col_rows[there]
                order = np.argsort(key, kind="stable")
                key = key[order]
                begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                val = np.add.reduceat((row_vals[cell] * col_vals[there])[order], begin)
                r, c = ids[first + key[begin] // len(others)], others[key[begin] % len(others)]
                for x, y in ((r, c),) if one else ((r, c), (c, r)):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(val)], names=["row", "col", "val"])


def gram(m: SparseMatrix) -> SparseMatrix:
    """The matrix by its transpose, which is symmetric: a product of two blocks of rows is made by one task, and stands on both sides.

    The blocks are stored and read where they lie; products are neither shuffled nor written on the way.
    """
    blocks = meeting.blocks(m.entries, GRAM_CELLS)
    if not blocks:
        return SparseMatrix(m.entries.select("row", F.col("row").alias("col"), F.col("val").cast("double").alias("val")).where("false"), m.nrows, m.nrows, m.name)
    met = meeting.crossed(blocks, ["ids", "row_n", "row_cols", "row_vals"], ["ids", "cols", "col_n", "col_rows", "col_vals"], above=True)
    return SparseMatrix(met.mapInArrow(_multiplied, "row long, col long, val double"), m.nrows, m.nrows, m.name)
