"""Command line: demo, analyze, reorder, benchmark."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import metrics
from .plans import methods
from .sources import files, generators

DEMO = {"demo": (100, 0.08), "analyze": (200, 0.05), "reorder": (200, 0.05), "benchmark": (300, 0.03)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kelvane")
    p.add_argument("command", choices=DEMO)
    p.add_argument("matrix", nargs="?", default="demo")
    p.add_argument("--methods", default="rcm,king")
    p.add_argument("--output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("kelvane").getOrCreate()
    n, density = DEMO[a.command]
    m = generators.generate(spark, n, n, density, "random_blocks") if a.matrix == "demo" else files.load(spark, a.matrix)
    if a.command == "analyze":
        metrics.matrix_properties(m).show(vertical=True)
        return 0
    chosen = {"demo": ["rcm", "king", "largest_first"], "benchmark": ["largest_first", "smallest_last", "rcm", "king", "diagonal"]}.get(a.command) or a.methods.split(",")
    results = methods.reorder(m, chosen)
    for name, r in results.items():
        if r.error:
            print(f"{name}: failed: {r.error}")
    compared = methods.comparison(m, results)
    for r in methods.summary(compared).collect():
        print(f"{r['method']}: bandwidth {r['bandwidth']:,} ({r['improvement_pct'] or 0:+.1f}%)")
    known = methods.findings(compared).first()
    print(f"{known['improving']} of {known['methods']} methods lower the bandwidth; best: {known['best_method']}")
    if a.output:
        compared.write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
