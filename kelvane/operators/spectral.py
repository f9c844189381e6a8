"""Least eigenvectors of a graph's Laplacian by filtered subspace iteration, and spectral clusters of graphs of any size.

The Laplacian is a bucketed table of entries, so that products with it do not shuffle it. A block of vectors is a table of one
row a vertex. A round applies a Chebyshev polynomial of the Laplacian to the block, which damps all but the least eigenvalues,
and then solves the eigenproblem within the block, from a few sums of products of its columns (Rayleigh-Ritz).
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import bucketed, discard, store
from . import graphs

#: Vectors beyond those asked for, degree of the filter, products of one plan, rounds at most.
GUARD, DEGREE, CHAIN, ROUNDS = 4, 12, 4, 60
#: Residual at which an eigenvector is accepted, as a share of the largest eigenvalue's bound.
ACCURACY = 1e-5


def laplacian(edges: DataFrame, n: int) -> tuple[DataFrame, float]:
    """(row, col, val) with every diagonal entry, bucketed by col; and a bound of its eigenvalues."""
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    once = store(once, "edges")
    degree = graphs.degrees(once, n)
    off = graphs.both_ways(once).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(-1.0).alias("val"))
    cells = off.unionByName(degree.select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("degree").cast("double").alias("val")))
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = bucketed(cells, "laplacian", ["col"], buckets)
    bound = out.where("row = col").agg(F.max("val")).first()[0]
    discard(once)
    return out, 2.0 * (bound or 0.0)


def _step(matrix: DataFrame, block: DataFrame, p: int, times: float, own: float, old: float) -> DataFrame:
    """(id, y, z) to (id, times * L y + own * y + old * z, y): one join and one aggregation."""
    met = matrix.join(block.withColumnRenamed("id", "col"), "col")
    diagonal = F.col("row") == F.col("col")
    new = [F.sum(F.col("val") * times * F.col(f"y{j}") + F.when(diagonal, own * F.col(f"y{j}") + old * F.col(f"z{j}")).otherwise(0.0)).alias(f"y{j}") for j in range(p)]
    return met.groupBy(F.col("row").alias("id")).agg(*new, *[F.sum(F.when(diagonal, F.col(f"y{j}")).otherwise(0.0)).alias(f"z{j}") for j in range(p)])


def _filtered(matrix: DataFrame, block: DataFrame, p: int, low: float, high: float) -> DataFrame:
    """The Chebyshev polynomial of [low, high], which is at most 1 there and grows below it, applied to the block.

    All steps but the first have the same coefficients, so that Spark compiles one step's code.
    """
    e, c, before = (high - low) / 2, (high + low) / 2, None
    for i in range(DEGREE):
        block = _step(matrix, block, p, *((2 / e, -2 * c / e, -1.0) if i else (1 / e, -c / e, 0.0)))
        if i % CHAIN == CHAIN - 1 or i == DEGREE - 1:
            block = store(block, "block")
            if before is not None:
                discard(before)
            before = block
    return block


def _ritz(matrix: DataFrame, block: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, combinations of the block's columns, and residuals of the eigenproblem within the block."""
    both = _step(matrix, block, p, 1.0, 0.0, 0.0)  # y: L times the block, z: the block
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = both.agg(*[F.sum(F.col(f"{a}{i}") * F.col(f"{b}{j}")).alias(f"{a}{b}{i}_{j}") for a, b in ("zz", "zy", "yy") for i, j in pairs]).first()
    grams = []
    for kind in ("zz", "zy", "yy"):
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = sums[f"{kind}{i}_{j}"] or 0.0
        grams.append(g)
    g, h, q = grams
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    weight, base = np.linalg.eigh(g * scale[:, None] * scale[None])
    on = weight > 1e-12 * weight.max()
    white = scale[:, None] * base[:, on] / np.sqrt(weight[on])
    values, inner = np.linalg.eigh(white.T @ h @ white)
    c = white @ inner
    left = np.einsum("ij,ik,kj->j", c, q, c) - 2 * values * np.einsum("ij,ik,kj->j", c, h, c) + values**2
    return values, c, np.sqrt(np.maximum(left, 0))


def _combined(block: DataFrame, c: np.ndarray) -> DataFrame:
    """The block's columns combined by c (old x new), as y; z is zero."""
    total = lambda j: reduce(Column.__add__, [F.col(f"y{i}") * float(c[i, j]) for i in range(len(c))])
    return block.select("id", *[total(j).alias(f"y{j}") for j in range(c.shape[1])], *[F.lit(0.0).alias(f"z{j}") for j in range(c.shape[1])])


def eigenvectors(edges: DataFrame, n: int, k: int, seed: int = 42, accuracy: float = ACCURACY, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The k least eigenvalues, ascending, and (id, y0, ..) with their vectors of length 1, the largest entry positive.

    Vectors that are not accurate after ``rounds`` rounds are returned with a warning.
    """
    matrix, bound = laplacian(edges, n)
    p = min(n, k + GUARD)
    draw = lambda j: F.xxhash64(F.lit(seed), F.lit(j), "id").cast("double") / 2.0**63
    block = edges.sparkSession.range(n).select("id", F.lit(1.0).alias("y0"), *[draw(j).alias(f"y{j}") for j in range(1, p)], *[F.lit(0.0).alias(f"z{j}") for j in range(p)])
    block, values = store(block, "block"), np.zeros(k)
    low, left = bound / 4, np.full(k, np.inf)
    for _ in range(rounds if bound else 0):
        new = _filtered(matrix, block, p, low, bound)
        values, c, left = _ritz(matrix, new, p)
        p = c.shape[1]
        combined = store(_combined(new, c), "block")
        discard(block, new)
        block = combined
        if p <= k or (left[:k] <= accuracy * bound).all():
            break
        # Powers of two, and not below what the filter's degree can tell apart.
        low = bound / 2 ** min(9, max(1, int(np.log2(bound / max(float(values[-1]), 1e-3 * bound)))))
    else:
        if bound:
            warnings.warn(f"eigenvectors are accurate to {left[:k].max() / bound:.1e} of the largest eigenvalue's bound only", stacklevel=2)
    k = min(k, p)
    tops = block.agg(*[F.struct(F.min(f"y{j}"), F.max(f"y{j}")).alias(f"t{j}") for j in range(k)]).first()
    sign = [-1.0 if -tops[f"t{j}"][0] > tops[f"t{j}"][1] * (1 + 1e-6) else 1.0 for j in range(k)]
    out = store(block.select("id", *[(F.col(f"y{j}") * sign[j]).alias(f"y{j}") for j in range(k)]), "eigenvectors")
    discard(block, matrix)
    return values[:k], out


def clusters(edges: DataFrame, n: int, k: int, seed: int = 42, tries: int = 4, **options) -> DataFrame:
    """(id, part): k-means over the k least eigenvectors, the best of some tries; parts are numbered by their least vertex.

    Of a graph of just k components, these vectors are constant on each and tell them apart: no iteration is needed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if k <= 1 or n <= k:
        return edges.sparkSession.range(n).select("id", (F.lit(0) if k <= 1 else F.col("id")).cast("int").alias("part"))
    known = graphs.apart(edges, n, k)
    if known is not None:
        return known
    _, vectors = eigenvectors(edges, n, k, seed, **options)
    points = VectorAssembler(inputCols=vectors.columns[1:], outputCol="point").transform(vectors).select("id", "point")
    models = [KMeans(k=k, seed=seed + i, maxIter=50, featuresCol="point", predictionCol="label").fit(points) for i in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    found = store(best.transform(points).select("id", "label"), "labels")
    first = sorted((r["first"], r["label"]) for r in found.groupBy("label").agg(F.min("id").alias("first")).collect())  # k rows
    names = F.create_map(*[F.lit(x) for place, (_, label) in enumerate(first) for x in (label, place)])
    return found.select("id", names[F.col("label")].cast("int").alias("part"))
