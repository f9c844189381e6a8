"""Equal-width histograms as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of x in [lo, hi], the last one closed; equal bounds are widened by a half on either side."""
    flat = lo == hi
    low, width = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, F.lit(1.0)).otherwise(hi - lo)
    return F.least(F.lit(bins - 1), F.floor((x - low) * bins / width)).cast("int")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) for every bin, empty ones included. One pass for the bounds, one for the counts."""
    x = df.select(F.col(column).cast("double").alias("x"))
    bounds = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    counts = x.join(F.broadcast(bounds)).select(bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # bounds: one row
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
