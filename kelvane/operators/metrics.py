"""Structural metrics of sparse matrices as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.histogram import histogram
from ..matrix import SparseMatrix
from .graphs import beside
from .numbering import numbered, running


def offset() -> Column:
    """How far an entry is below the diagonal."""
    return F.col("row") - F.col("col")


def bandwidth(m: SparseMatrix) -> DataFrame:
    return m.entries.agg(F.coalesce(F.max(F.abs(offset())), F.lit(0)).cast("long").alias("bandwidth"))


def profile(m: SparseMatrix) -> DataFrame:
    """Distance from each row's first entry to the diagonal, plus one, summed; and with negative terms as 0."""
    term = F.col("row") - F.col("first") + 1
    return m.entries.groupBy("row").agg(F.min("col").alias("first")).agg(F.coalesce(F.sum(term), F.lit(0)).cast("long").alias("profile"), F.coalesce(F.sum(F.greatest(term, F.lit(0))), F.lit(0)).cast("long").alias("profile_clamped"))


def max_wavefront(m: SparseMatrix) -> DataFrame:
    """The count of active columns never rises along the rows, so that its maximum is that of non-empty columns."""
    return m.entries.agg(F.countDistinct("col").cast("long").alias("max_wavefront"))


def wavefront_curve(m: SparseMatrix) -> DataFrame:
    """(row, active): columns c >= row with an entry at or below the row."""
    last = m.entries.groupBy("col").agg(F.least(F.col("col"), F.max("row")).alias("until"))
    ends = last.groupBy("until").agg(F.count("*").alias("n"))
    steps = m.row_ids().join(ends, F.col("row") == F.col("until"), "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    return running(steps, "n", F.col("row").desc(), name="active").select("row", F.col("active").cast("long").alias("active"))


def counts(m: SparseMatrix, axis: str = "row") -> DataFrame:
    """(axis, n, value_sum) of every row or column, empty ones included."""
    size = m.nrows if axis == "row" else m.ncols
    own = m.entries.groupBy(axis).agg(F.count("*").alias("n"), F.sum("val").alias("value_sum"), (F.max("col") - F.min("col")).alias("width"))
    return m.spark.range(size).withColumnRenamed("id", axis).join(own, axis, "left").select(axis, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value_sum", F.lit(0.0)).alias("value_sum"), F.coalesce("width", F.lit(0)).alias("width"))


def _axis_stats(m: SparseMatrix, axis: str, prefix: str) -> DataFrame:
    """nnz and the statistics of the numbers of entries. Empty rows are put in by their number: no table of all rows is made."""
    size = m.nrows if axis == "row" else m.ncols
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own = m.entries.groupBy(axis).agg(F.count("*").alias("n"))
    one = own.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.min("n").alias("lo"), F.max("n").alias("hi"), zero(F.avg("n")).alias("mean"), zero(F.var_pop("n")).alias("var"))
    k, all_ = F.col("k").cast("double"), F.lit(float(size))
    var = F.try_divide(k * F.col("var") + k * F.try_divide(all_ - k, all_) * F.col("mean") * F.col("mean"), all_)
    some = F.lit(size > 0)
    return one.select(
        "nnz", F.round(F.try_divide("nnz", all_), 6).alias(f"{prefix}_avg"), F.when(some, F.coalesce("hi", F.lit(0))).alias(f"{prefix}_max"),
        F.when(some, F.when(k < all_, F.lit(0)).otherwise(F.col("lo"))).alias(f"{prefix}_min"),
        F.round(F.sqrt(var), 6).alias(f"{prefix}_std"), F.round(var, 6).alias(f"{prefix}_var"), (F.lit(size) - F.col("k")).alias(f"{prefix}_empty"),
    )


def _shape(m: SparseMatrix) -> list[Column]:
    density = F.round(F.try_divide(F.col("nnz") * 100.0, F.lit(float(m.nrows) * m.ncols)), 9).alias("density_pct")
    return [F.lit(m.nrows).cast("long").alias("nrows"), F.lit(m.ncols).cast("long").alias("ncols"), F.col("nnz"), density]


def matrix_stats(m: SparseMatrix) -> DataFrame:
    """Shape, entries, density in percent, entries per row, squareness."""
    return _axis_stats(m, "row", "row").select(*_shape(m), "row_avg", "row_max", "row_min", "row_std", F.lit(m.square).alias("is_square"))


def matrix_properties(m: SparseMatrix) -> DataFrame:
    """Statistics of rows and columns, bandwidth and true symmetry."""
    m = m.stored()
    tables = [_axis_stats(m, "row", "row"), _axis_stats(m, "col", "col").drop("nnz"), bandwidth(m)]
    if m.square:
        # A cell and its mirror image meet under one key: no join with the transpose.
        mirrored = m.entries.where("row <> col").groupBy(F.least("row", "col"), F.greatest("row", "col")).agg(F.count("*").alias("n"), F.min("val").alias("lo"), F.max("val").alias("hi"))
        tables.append(mirrored.agg((F.count_if((F.col("n") < 2) | ~F.col("lo").eqNullSafe(F.col("hi"))) == 0).alias("is_symmetric")))
    out = beside(*tables)
    axes = [f"{a}_{x}" for a in ("row", "col") for x in ("avg", "max", "min", "std", "var", "empty")]
    return out.select(*_shape(m), F.lit(m.square).alias("is_square"), *axes, "bandwidth", F.col("is_symmetric") if m.square else F.lit(False).alias("is_symmetric"))


def structure(m: SparseMatrix, bins: int = 10) -> DataFrame:
    """Shape, entries, density as a fraction, and by rows and by columns: average, deviation, least, most, empty ones and a histogram."""
    m = m.stored()
    tables = [_axis_stats(m, "row", "row"), _axis_stats(m, "col", "col").drop("nnz")]
    for axis in ("row", "col"):
        hist = histogram(counts(m, axis), "n", bins)
        tables.append(hist.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias(f"{axis}_distribution")))
    per = [f"{a}_{x}" for a in ("row", "col") for x in ("avg", "std", "min", "max", "empty", "distribution")]
    density = F.round(F.try_divide("nnz", F.lit(float(m.nrows) * m.ncols)), 9)
    return beside(*tables).select(F.lit(m.nrows).cast("long").alias("nrows"), F.lit(m.ncols).cast("long").alias("ncols"), "nnz", density.alias("density"), F.lit(m.square).alias("is_square"), *per)


def sparsity_summary(m: SparseMatrix) -> DataFrame:
    diagonal, nnz = F.count_if(F.col("row") == F.col("col")), F.count("*")
    ratio = F.try_divide(diagonal, nnz)
    return m.entries.agg(
        F.round(ratio, 6).alias("diagonal_ratio"), F.coalesce(ratio > 0.5, F.lit(False)).alias("diagonal_dominant"),
        (F.max("row") - F.min("row") + 1).alias("row_span"), (F.max("col") - F.min("col") + 1).alias("col_span"),
        F.coalesce(F.max(F.abs(offset())), F.lit(0)).alias("bandwidth"), F.when(nnz == 0, "empty").otherwise("general").alias("pattern_type"),
    )


def sparsity_structure(m: SparseMatrix) -> DataFrame:
    diagonal = F.count_if(F.col("row") == F.col("col"))
    return m.entries.agg(
        diagonal.alias("diagonal_nnz"), F.round(F.try_divide(diagonal, F.lit(min(m.nrows, m.ncols))), 6).alias("diagonal_ratio"), (diagonal > F.count("*") / 2).alias("diagonal_dominant"),
        F.max(F.when(offset() >= 0, offset())).alias("max_upper_offset"), F.min(F.when(offset() <= 0, offset())).alias("max_lower_offset"), F.coalesce(F.max(F.abs(offset())), F.lit(0)).alias("bandwidth"),
    )


def offset_histogram(m: SparseMatrix, bins: int = 20) -> DataFrame:
    return histogram(m.entries.select(offset().alias("offset")), "offset", bins)


def block_size(m: SparseMatrix) -> int:
    return min(100, m.nrows // 10) if m.nrows > 100 else m.nrows // 2


def block_density(m: SparseMatrix, size: int | None = None) -> DataFrame:
    """Statistics of the densities of all full blocks, empty ones included."""
    size = size or block_size(m)
    across, down = (m.ncols // size, m.nrows // size) if size else (0, 0)
    blocks = across * down
    inside = m.entries.where((F.col("row") < down * size) & (F.col("col") < across * size))
    d = inside.groupBy(F.floor(F.col("row") / size).alias("i"), F.floor(F.col("col") / size).alias("j")).agg((F.count("*") / float(max(1, size * size))).alias("d"))
    s, q = F.coalesce(F.sum("d"), F.lit(0.0)), F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0))
    mean = s / float(max(1, blocks))
    return d.agg(F.lit(blocks).cast("long").alias("blocks"), F.round(mean, 6).alias("avg_density"), F.round(F.sqrt(F.greatest(q / float(max(1, blocks)) - mean * mean, F.lit(0.0))), 6).alias("std_density"), F.count_if(F.col("d") > 0.1).alias("dense_blocks"), (F.lit(blocks) - F.count("*") + F.count_if(F.col("d") < 0.01)).cast("long").alias("sparse_blocks"))


def recommendations(m: SparseMatrix) -> DataFrame:
    """Advice from density, bandwidth and diagonal share."""
    ratio = F.try_divide(F.count_if(F.col("row") == F.col("col")), F.count("*"))
    one = m.entries.agg(F.count("*").alias("nnz"), F.coalesce(F.max(F.abs(offset())), F.lit(0)).alias("bandwidth"), F.coalesce(ratio > 0.5, F.lit(False)).alias("diagonal_dominant"))
    s = one.select(_shape(m)[3], "bandwidth", "diagonal_dominant")
    first = F.when(F.col("density_pct") > 10, "dense").when(F.col("bandwidth") < 0.1 * m.nrows, "banded")
    return s.select("density_pct", "bandwidth", F.array_join(F.array_compact(F.array(first, F.when(F.col("diagonal_dominant"), "diagonal"))), ",").alias("recommendations"))


def memory_usage(m: SparseMatrix, original: str = "csr") -> DataFrame:
    """Bytes by format, with 8-byte values and 4-byte indices, and what a format takes more than the original one.

    A dictionary of keys has no such arrays: its row has an error instead.
    """
    nnz = F.count("*")
    sizes = {"csr": nnz * 12 + 4 * (m.nrows + 1), "csc": nnz * 12 + 4 * (m.ncols + 1), "coo": nnz * 16}
    one = m.entries.agg(*[v.cast("long").alias(k) for k, v in sizes.items()], F.lit(None).cast("long").alias("dok"))
    rows = F.array(*[F.struct(F.lit(k).alias("format"), F.col(k).alias("bytes"), (F.col(k) - F.col(original)).alias("overhead_bytes")) for k in (*sizes, "dok")])
    return one.select(F.inline(rows)).withColumn("error", F.when(F.col("bytes").isNull(), "no arrays"))


def spmv_characteristics(m: SparseMatrix) -> DataFrame:
    """Row lengths, and the strides of the column indices in row order.

    Strides inside rows come from a window by row, those between rows from a join of each row's last column with the next
    row's first; the entries, and the rows, are never put into one partition.
    """
    m = m.stored()
    inside = m.entries.select((F.col("col") - F.lag("col").over(Window.partitionBy("row").orderBy("col"))).alias("d")).where("d IS NOT NULL")
    ends = numbered(m.entries.groupBy("row").agg(F.min("col").alias("lo"), F.max("col").alias("hi")), "row", name="k")
    between = ends.select("k", "lo").join(ends.select((F.col("k") + 1).alias("k"), "hi"), "k").select((F.col("lo") - F.col("hi")).alias("d"))
    d = F.col("d").cast("double")
    n = F.count("*")
    strides = inside.unionByName(between).agg(F.round(F.sum(F.abs(d)) / n, 6).alias("avg_access_stride"), F.round(F.sqrt(F.sum(d * d) / n - (F.sum(d) / n) * (F.sum(d) / n)), 6).alias("memory_irregularity"))
    out = beside(_axis_stats(m, "row", "row"), strides).withColumn("density", F.round(F.col("nnz") / float(max(1, m.nrows * m.ncols)), 9)).drop("nnz")
    rules = [F.when(F.col("row_var") < 10, "vectorized"), F.when(F.col("memory_irregularity") > 100, "blocked"), F.when(F.col("density") > 0.1, "dense_optimization"), F.when(F.col("row_avg") < 10, "coo_format")]
    return out.withColumn("recommendations", F.array_join(F.array_compact(F.array(*rules)), ","))


MEASURES = ("bandwidth", "profile", "max_wavefront")


def measures(matrices: dict[str, SparseMatrix]) -> DataFrame:
    """(method, bandwidth, profile, max_wavefront) of several matrices, each scanned once."""
    every = None
    for name, m in matrices.items():
        own = m.entries.select(F.lit(name).alias("method"), "row", "col")
        every = own if every is None else every.unionByName(own)
    # Rows and columns are counted in one pass: an entry goes to its row's key, with its column, and to its column's.
    sides = F.array(F.struct(F.lit(True).alias("is_row"), F.col("row").alias("key"), F.col("col").alias("other")), F.struct(F.lit(False).alias("is_row"), F.col("col").alias("key"), F.col("row").alias("other")))
    keys = every.select("method", F.explode(sides).alias("s")).select("method", "s.*").groupBy("method", "is_row", "key").agg(F.min("other").alias("first"), F.max("other").alias("last"))
    far = F.greatest(F.abs(F.col("key") - F.col("first")), F.abs(F.col("key") - F.col("last")))
    one = keys.groupBy("method").agg(F.max(far).alias("bandwidth"), F.sum(F.when(F.col("is_row"), F.col("key") - F.col("first") + 1)).alias("profile"), F.count_if(~F.col("is_row")).alias("max_wavefront"))
    names = every.sparkSession.createDataFrame([(x,) for x in matrices], "method string")  # an empty matrix has no rows
    return F.broadcast(names).join(one, "method", "left").select("method", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in MEASURES])


def compare(original: SparseMatrix, others: dict[str, SparseMatrix]) -> DataFrame:
    """(method, metric, original, value, improvement_pct), null where the original is 0."""
    base = measures({"original": original}).unpivot([], list(MEASURES), "metric", "original")
    rows = measures(others).unpivot(["method"], list(MEASURES), "metric", "value")
    gain: Column = F.when(F.col("original") > 0, F.round((F.col("original") - F.col("value")) * 100.0 / F.col("original"), 6))
    return rows.join(F.broadcast(base), "metric").select("method", "metric", "original", "value", gain.alias("improvement_pct"))
