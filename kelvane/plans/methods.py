"""Reordering methods by name, and comparing, ranking, timing and reporting them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..operators import coloring, metrics, orderings, partitions, products
from ..operators.graphs import beside
from ..sources.storage import store

Method = Callable[[SparseMatrix], tuple[DataFrame | None, DataFrame | None]]
_methods: dict[str, Method] = {}


def register(name: str, method: Method) -> None:
    """A method gives the permutations of rows and of columns (either may be None)."""
    _methods[name] = method


def names() -> list[str]:
    return sorted(_methods)


def _rcm(m: SparseMatrix):
    p = orderings.rcm(m)
    return p, p if m.square else None


def _dissection(m: SparseMatrix):
    p = partitions.nested_dissection(m)
    return p, p


register("rcm", _rcm)
register("king", lambda m: (orderings.king(m), None))
register("diagonal", lambda m: (orderings.diagonal(m), None))
register("block_reverse", lambda m: (orderings.block_reverse(m), None))
register("nested_dissection", _dissection)
for _s in coloring.STRATEGIES:
    register(_s, lambda m, s=_s: (coloring.order(m, s), None))
for _p in partitions.METHODS:
    register(f"partition_{_p}", lambda m, p=_p: (partitions.order(m, method=p), None))


@dataclass
class Reordering:
    matrix: SparseMatrix | None = None
    rows: DataFrame | None = None
    cols: DataFrame | None = None
    error: str | None = None
    info: dict = field(default_factory=dict)


def reorder(m: SparseMatrix, chosen: list[str] | None = None) -> dict[str, Reordering]:
    """Each method's result, or its error. The permutations are written here, so that an error belongs to its method."""
    chosen, m = ["largest_first", "rcm", "king", "diagonal"] if chosen is None else chosen, m.stored()
    if unknown := [x for x in chosen if x not in _methods]:
        raise ValueError(f"unknown methods {unknown}; known: {names()}")
    out = {}
    for name in chosen:
        try:
            rows, cols = _methods[name](m)
            same = cols is rows
            rows = None if rows is None else store(rows, "permutation")
            cols = rows if same else None if cols is None else store(cols, "permutation")
            out[name] = Reordering(m.gather(rows, cols), rows, cols)
        except Exception as e:
            out[name] = Reordering(error=str(e))
    return out


def whole(results: dict[str, Reordering]) -> dict[str, Reordering]:
    """``results``, if no method failed: a comparison of the others would look like one of all."""
    if failed := {k: r.error for k, r in results.items() if r.error is not None}:
        raise RuntimeError("methods failed: " + "; ".join(f"{k}: {e}" for k, e in failed.items()))
    return results


def comparison(m: SparseMatrix, results: dict[str, Reordering]) -> DataFrame:
    return metrics.compare(m, {k: r.matrix for k, r in results.items() if r.error is None})


def summary(compared: DataFrame) -> DataFrame:
    """(method, bandwidth, improvement_pct), best first."""
    own = compared.where(F.col("metric") == "bandwidth").select("method", F.col("value").alias("bandwidth"), "improvement_pct")
    return own.orderBy(F.col("improvement_pct").desc_nulls_last(), "method")


def findings(compared: DataFrame, colors: dict[str, DataFrame] | None = None) -> DataFrame:
    """How many methods lower the bandwidth, of how many; the best one's name and gain; and the fewest colours (null without colourings).

    colors: tables as ``coloring.quality`` gives them, by strategy.
    """
    own = compared.where(F.col("metric") == "bandwidth")
    best = F.max_by(F.struct("method", "value", "improvement_pct"), F.struct("improvement_pct", F.col("value") * -1, "method"))
    one = own.agg(F.count("*").alias("methods"), F.count_if(F.col("improvement_pct") > 0).alias("improving"), best.alias("best"))
    one = one.select("methods", "improving", F.col("best.method").alias("best_method"), F.col("best.value").alias("best_bandwidth"), F.col("best.improvement_pct").alias("best_improvement_pct"))
    few = None
    for q in (colors or {}).values():
        few = q.select("num_colors") if few is None else few.unionByName(q.select("num_colors"))
    fewest = one.sparkSession.range(1).select(F.lit(None).cast("long").alias("min_colors")) if few is None else few.agg(F.min("num_colors").alias("min_colors"))
    return beside(one, fewest)


def ranking(compared: DataFrame, metric: str = "bandwidth", k: int = 3) -> DataFrame:
    """The k methods that improve a metric most."""
    return compared.where(F.col("metric") == metric).orderBy(F.col("improvement_pct").desc_nulls_last(), "method").limit(k)


def seconds(df: DataFrame, warmup: int = 1, runs: int = 5) -> float:
    """Median time of an action that makes all rows and keeps none."""
    taken = []
    for i in range(warmup + runs):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        if i >= warmup:
            taken.append(time.perf_counter() - t)
    return sorted(taken)[len(taken) // 2]


def benchmark_spmv(m: SparseMatrix, x: DataFrame, strategies=("shuffle", "broadcast", "blocked"), warmup: int = 1, runs: int = 5) -> dict[str, dict]:
    nnz, out = m.entries.count(), {}
    for s in strategies:
        try:
            t = seconds(products.spmv(m, x, s), warmup, runs)
            out[s] = {"avg_time_ms": t * 1e3, "gflops": 2 * nnz / t / 1e9, "bandwidth_gb_s": 8 * (nnz + m.nrows + m.ncols) / t / 1e9, "matrix_shape": [m.nrows, m.ncols], "nnz": nnz}
        except Exception as e:
            out[s] = {"error": str(e)}
    return out


def benchmark_layouts(m: SparseMatrix, x: DataFrame, layouts=("csr", "csc", "coo"), runs: int = 5) -> dict[str, dict]:
    """SpMV over entries laid out by row, by column, or as they come."""
    out = {}
    for name in layouts:
        try:
            laid = store(m.entries if name == "coo" else m.layout({"csr": "row", "csc": "col"}[name]), name)
            one = next(iter(benchmark_spmv(SparseMatrix(laid, m.nrows, m.ncols), x, ("shuffle",), 1, runs).values()))
            out[name] = one | {"memory_mb": {r["format"]: r["bytes"] for r in metrics.memory_usage(m).collect()}[name] / 1e6}
        except Exception as e:
            out[name] = {"error": str(e)}
    return out


def reordering_impact(m: SparseMatrix, results: dict[str, Reordering], x: DataFrame, runs: int = 5) -> dict[str, dict]:
    """Times of the reordered products; the vector is permuted where columns were."""
    base, out = benchmark_spmv(m, x, ("shuffle",), 1, runs)["shuffle"], {}
    for name, r in results.items():
        if r.error is not None:
            out[name] = {"error": r.error}
            continue
        v = x if r.cols is None else x.join(r.cols, F.col("idx") == F.col("old_id")).select(F.col("new_pos").alias("idx"), "val")
        one = benchmark_spmv(r.matrix, v, ("shuffle",), 1, runs)["shuffle"]
        if "error" not in one and "error" not in base:
            one["improvement_percent"] = (base["avg_time_ms"] - one["avg_time_ms"]) / base["avg_time_ms"] * 100
        out[name] = one
    return out


def scalability(generate: Callable[[int], SparseMatrix], sizes, vector: Callable[[int], DataFrame], runs: int = 3) -> dict[int, dict]:
    out = {}
    for n in sizes:
        try:
            out[n] = benchmark_spmv(generate(n), vector(n), ("shuffle",), 1, runs)
        except Exception as e:
            out[n] = {"error": str(e)}
    return out


def scan_bandwidth(spark: SparkSession, sizes=(1024, 4096, 16384, 65536, 262144, 1048576), types=("float", "double")) -> dict[str, dict]:
    """Rows of a type made and read again, as a rate."""
    width = {"float": 4, "double": 8}
    return {f"{t}32" if t == "float" else "float64": {n: width[t] * n / seconds(spark.range(n).select(F.col("id").cast(t))) / 1e9 for n in sizes} for t in types}


def comprehensive(m: SparseMatrix, x: DataFrame, results: dict[str, Reordering] | None = None, output: str | None = None, runs: int = 3) -> dict:
    out = {"matrix_analysis": metrics.spmv_characteristics(m).first().asDict(), "format_comparison": benchmark_layouts(m, x, runs=runs), "method_comparison": benchmark_spmv(m, x, runs=runs), "memory_bandwidth": scan_bandwidth(m.spark, (1024, 65536))}
    if results:
        out["reordering_impact"] = reordering_impact(m, results, x, runs)
    if output:
        save_results(out, output)
    return out


def save_results(results: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(results, f, indent=2, default=lambda o: o.item() if hasattr(o, "item") else list(o))


def load_results(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def write_report(results: dict, path: str = "benchmark_report.txt") -> str:
    """The report as a text file; gives its path."""
    with open(path, "w") as f:
        f.write(report(results))
    return path


def report(results: dict) -> str:
    """Text of a comprehensive result; error entries are left out."""
    lines = ["SpMV benchmark report"]
    for title, part in results.items():
        lines += ["", title.replace("_", " ").capitalize()]
        for k, v in part.items():
            if isinstance(v, dict):
                if "error" not in v:
                    lines.append(f"  {k}: " + ", ".join(f"{a} {b:.3f}" if isinstance(b, float) else f"{a} {b}" for a, b in v.items()))
            else:
                lines.append(f"  {k}: {v}")
    return "\n".join(lines) + "\n"
