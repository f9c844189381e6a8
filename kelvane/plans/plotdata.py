"""The data behind the plots, as DataFrames; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import histogram
from ..matrix import SparseMatrix
from ..operators import metrics


def sparsity(m: SparseMatrix, bins: int | None = None) -> DataFrame:
    """(row, col, n): the entries, or their counts on a grid of bins for large matrices."""
    if bins is None:
        return m.entries.select("row", "col", F.lit(1).cast("long").alias("n"))
    cell = lambda c, size: F.floor(F.col(c) * bins / max(1, size)).cast("long").alias(c)
    return m.entries.groupBy(cell("row", m.nrows), cell("col", m.ncols)).agg(F.count("*").alias("n"))


def side_by_side(matrices: dict[str, SparseMatrix], of=sparsity) -> DataFrame:
    """One of these tables for several matrices, with their names."""
    out = None
    for name, m in matrices.items():
        own = of(m).withColumn("name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def bandwidths(matrices: dict[str, SparseMatrix], empty: int | None = 0) -> DataFrame:
    """Bandwidths by name; ``empty`` is that of a matrix without entries."""
    own = F.when(F.col("max_wavefront") > 0, F.col("bandwidth")).otherwise(F.lit(empty).cast("long"))
    return metrics.measures(matrices).select(own.alias("bandwidth"), F.col("method").alias("name"))


def row_widths(m: SparseMatrix) -> DataFrame:
    return metrics.counts(m).select("row", F.col("width").cast("long").alias("width"))


def row_width_histogram(m: SparseMatrix, bins: int = 50) -> DataFrame:
    return histogram(row_widths(m), "width", bins)


def nonzeros(m: SparseMatrix, axis: str = "row") -> DataFrame:
    """Entries and value sums of rows or columns."""
    return metrics.counts(m, axis).select(axis, F.col("n").alias("nnz"), "value_sum")


def value_sum_histogram(m: SparseMatrix, axis: str = "row", most: int = 30) -> DataFrame:
    """Histogram of the value sums of rows or columns, of as many bins as there are distinct sums, ``most`` at most."""
    sums = metrics.counts(m, axis).select("value_sum")
    distinct = sums.distinct().limit(most).count()
    return histogram(sums, "value_sum", max(1, distinct))


#: Matrices that are looked at one by one.
DETAILED = 3


def comprehensive(matrices: dict[str, SparseMatrix], bins: int | None = None) -> dict[str, DataFrame]:
    """The tables behind the plots of several matrices: patterns and bandwidths of all, and details of the first three.

    A matrix whose details fail has none; the rest is there.
    """
    matrices = {k: m.stored() for k, m in matrices.items()}
    out = {"sparsity_comparison": side_by_side(matrices, lambda m: sparsity(m, bins)), "bandwidth_evolution": bandwidths(matrices)}
    for name, m in list(matrices.items())[:DETAILED]:
        stem = name.lower().replace(" ", "_").replace("-", "_")
        for kind, make in (("bandwidth_profile", row_widths), ("nnz_distribution", _distribution)):
            try:
                out[f"{stem}_{kind}"] = make(m)
            except Exception:  # the same as for a plot: one that fails is left out
                continue
    return out


def _distribution(m: SparseMatrix) -> DataFrame:
    """(axis, bin, n) of the value sums of rows and of columns."""
    return value_sum_histogram(m).withColumn("axis", F.lit("row")).unionByName(value_sum_histogram(m, "col").withColumn("axis", F.lit("col")))


def report(original: SparseMatrix, reordered: dict[str, SparseMatrix], bins: int | None = None) -> dict[str, DataFrame]:
    """Patterns and bandwidths of a matrix and of its reorderings."""
    matrices = {"Original": original, **reordered}
    return {"sparsity_comparison": side_by_side(matrices, lambda m: sparsity(m, bins)), "bandwidth_comparison": bandwidths(matrices)}
