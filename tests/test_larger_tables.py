"""Queries over tables that are larger, or more even, than the given ones."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from kelvane.matrix import SparseMatrix
from kelvane.operators import partitions
from kelvane.plans import catalog


@pytest.fixture(scope="module")
def even(spark, tmp_path_factory):
    """25 customers and suppliers, one a nation, and an order line for each pair of nations: no flow is above the mean."""
    d = str(tmp_path_factory.mktemp("even"))
    key = lambda n, **cols: spark.range(n).select(*[c.alias(k) for k, c in cols.items()])
    i = F.col("id")
    tables = {
        "customer": key(25, c_custkey=i, c_nationkey=i.cast("int")), "supplier": key(25, s_suppkey=i, s_nationkey=i.cast("int")),
        "orders": key(25, o_orderkey=i, o_custkey=i), "part": key(30, p_partkey=i, p_size=F.lit(1)),
        "lineitem": key(625, l_orderkey=F.floor(i / 25), l_suppkey=i % 25, l_partkey=i % 30, l_quantity=F.lit(1.0)),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    r = con.execute(catalog.oracle_sql()[name])
    names, rows = [c[0] for c in r.description], r.fetchall()
    own = catalog.queries()[name](spark, d).select(*names).collect()
    plain = lambda rows: sorted([tuple("NaN" if isinstance(x, float) and math.isnan(x) else x for x in row) for row in rows], key=str)
    assert plain(own) == plain(rows)


EMPTY_FLOW = ["bandwidth_evolution", "best_method", "compare_reorderings", "reordering_summary", "reordering_findings", "block_density", "recommendations", "sparsity_summary", "partition_quality"]


@pytest.mark.parametrize("name", EMPTY_FLOW)
def test_empty_flow(spark, even, name):
    same_as_sql(spark, even, name)


def path(spark, n):
    """A path whose vertices are numbered out of order, and its vertices along it (the smaller end first)."""
    line = [(i * 7 + 3) % n for i in range(n)]
    assert sorted(line) == list(range(n))
    return spark.createDataFrame([(min(p), max(p)) for p in zip(line, line[1:])], "src long, dst long"), line if line[0] < line[-1] else line[::-1]


def test_recursive_long_path(spark, monkeypatch):
    """Beyond one task, a path falls into the same parts as in a task."""
    edges, _ = path(spark, 200)
    inside = {r["id"]: r["part"] for r in partitions.partition(edges, 200, 5, "recursive").collect()}
    monkeypatch.setattr(partitions, "TASK_NODES", 20)
    assert {r["id"]: r["part"] for r in partitions.partition(edges, 200, 5, "recursive").collect()} == inside


def test_places(spark):
    from kelvane.operators import paths

    edges, line = path(spark, 50)
    assert [r["id"] for r in paths.places(edges, 50).orderBy("place").collect()] == line
    assert paths.places(edges, 51) is None
    ring = spark.createDataFrame([(50, 51), (51, 52), (50, 52)], "src long, dst long")
    assert paths.places(edges.unionByName(ring), 53) is None


def test_dissection_long_path(spark):
    """Beyond one task, a path is dissected as in a task."""
    _, line = path(spark, 200)
    cells = [(v, i + k) for i, v in enumerate(line) for k in (0, 1) if i + k < 200]
    m = SparseMatrix(spark.createDataFrame([(r, c, 1.0) for r, c in cells], "row long, col long, val double"), 200, 200)
    inside = {tuple(r) for r in partitions.nested_dissection(m, 10).collect()}
    assert {tuple(r) for r in partitions.nested_dissection(m, 10, task_nodes=40).collect()} == inside


def test_compressible_table_not_sent(spark):
    """A table that is small in its files only is not sent to all tasks."""
    from kelvane.sources.storage import store

    rows = store(spark.range(400_000).withColumn("level", F.lit(1)).withColumn("name", F.lit("the same text in all rows")), "rows")
    one = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert one > 10 * 1024 * 1024
    joined = rows.join(rows.select("id", F.col("level").alias("other")), "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_components_without_hubs(spark):
    """A star and a chain, numbered at random: the least number of each; no key of any round's join has the whole component."""
    from kelvane.operators import graphs

    star = [(500, i) for i in range(500)]
    line = [501 + (i * 7) % 300 for i in range(300)]
    edges = spark.createDataFrame([(min(p), max(p)) for p in star + list(zip(line, line[1:]))], "src long, dst long")
    found = {r["id"]: r["component"] for r in graphs.components(edges, 802).collect()}
    assert found == {**dict.fromkeys(range(501), 0), **dict.fromkeys(range(501, 801), 501), 801: 801}


def rectangle(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    cells = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, 60, 90), rng.integers(0, 80, 90))})
    return SparseMatrix(spark.createDataFrame([(r, c, 1.0) for r, c in cells], "row long, col long, val double"), 70, 80), cells


def test_overlap_degrees(spark):
    """Rows that share a column with each, counted by blocks and shares."""
    from kelvane.operators import orderings

    m, cells = rectangle(spark)
    near = {r: {s for s, d in cells for q, c in cells if q == r and c == d} - {r} for r, _ in cells}
    found = {r["id"]: r["degree"] for r in orderings.overlap_degrees(m.entries, 70, 20, 30).collect()}
    assert found == {r: len(x) for r, x in near.items()}


def test_overlap_order_without_edges(spark, monkeypatch):
    """Rows' order by shared columns, with and without the overlap graph's edges; no edges are made."""
    from kelvane.operators import graphs, orderings

    m, _ = rectangle(spark)
    expected = {tuple(r) for r in orderings.reverse_cuthill_mckee(graphs.row_overlap(m), 70).collect()}
    monkeypatch.setattr(graphs, "row_overlap", None)
    assert {tuple(r) for r in orderings.rcm(m).collect()} == expected

def test_pairs_not_shuffled(spark):
    """Products and pairs of rows are made by the task of their row: nothing is shuffled after they are; hot columns are cut."""
    import numpy as np

    from kelvane.operators import graphs, products

    g = np.random.default_rng(3)
    a = np.where(g.random((60, 30)) < 0.2, g.integers(1, 9, (60, 30)), 0).astype(float)
    a[:50, 3] = 2
    m = SparseMatrix(spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, col long, val double"), 60, 30)
    after = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("Generate posexplode")[0]
    want = {(int(i), int(j)): (a @ a.T)[i, j] for i, j in zip(*np.nonzero(a @ a.T))}
    for c in (products.gram(m), products.spgemm(m, m.transpose())):
        assert "Exchange" not in after(c.entries)
        assert {(r["row"], r["col"]): r["val"] for r in c.entries.collect()} == want
    for block in (4, 2048):
        e = graphs.row_overlap(m, block)
        assert "Exchange" not in after(e)
        assert sorted(tuple(r) for r in e.collect()) == sorted(k for k in want if k[0] < k[1])


def test_packed_pieces(spark):
    """A sparse matrix is packed into few pieces, whatever its number of rows."""
    from kelvane.operators import products

    cells = spark.range(4000).select((F.col("id") * 1000).alias("row"), (F.col("id") % 100).alias("col"), F.lit(1.0).alias("val"))
    m = SparseMatrix(cells, 4_000_000, 100)
    blocks = products.packed(m, 50)
    assert blocks.count() <= 6 and sum(len(r["rows"]) for r in blocks.collect()) == 4000
    y = products.spmv_packed(blocks, m, spark.range(100).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("val")), 50)
    assert y.where("val <> IF(idx % 1000 = 0, idx DIV 1000 % 100, 0)").isEmpty() and y.count() == 4_000_000


def sparse(spark, n=120, m=260, seed=7):
    import numpy as np

    g = np.random.default_rng(seed)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in g.integers(0, n, (m, 2)).tolist() if a != b})
    return spark.createDataFrame(pairs, "src long, dst long"), pairs, n


def test_edges_stay_in_buckets(spark, monkeypatch):
    """Cores and independent sets of many edges: as of few, and the edges that rounds join are not shuffled."""
    from kelvane.operators import coloring, graphs

    edges, _, n = sparse(spark)
    of = lambda f: {tuple(r) for r in f(edges, n).collect()}
    few = [of(f) for f in (coloring.cores, coloring.independent_sets)]
    monkeypatch.setattr(graphs, "BUCKETED_EDGES", 1)
    assert [of(f) for f in (coloring.cores, coloring.independent_sets)] == few
    two = graphs.laid_out(edges, "dst")
    plan = two.join(spark.range(5).withColumnRenamed("id", "dst").hint("merge"), "dst")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sets_read_open_edges_only(spark, monkeypatch):
    """Each round of a colour reads the edges among vertices that are still open: fewer than the rounds before."""
    from kelvane.operators import coloring

    edges, pairs, n = sparse(spark)
    sizes, among = [], coloring._among
    monkeypatch.setattr(coloring, "_among", lambda two, gone: sizes.append(two.count()) or among(two, gone))
    colors = dict(tuple(r) for r in coloring.independent_sets(edges, n).collect())
    assert all(colors[a] != colors[b] for a, b in pairs) and len(colors) == n
    assert sizes[0] == 2 * len(pairs) and sum(sizes) < 5 * sizes[0] and min(sizes) == 0


def test_components_are_clusters_and_parts(spark, monkeypatch):
    """A graph of just k components needs no eigenvectors, and no coarsening if they are even."""
    from kelvane.operators import multilevel, spectral

    n = 60
    rows = spark.range(n)
    chains = rows.select(F.col("id").alias("src"), (F.col("id") + 3).alias("dst")).where(F.col("dst") < n)
    monkeypatch.setattr(spectral, "eigenvectors", None)
    third = {i: i % 3 for i in range(n)}
    assert {r["id"]: r["part"] for r in spectral.clusters(chains, n, 3).collect()} == third
    with monkeypatch.context() as patch:
        patch.setattr(multilevel, "split", None)
        assert {r["id"]: r["part"] for r in multilevel.partition(chains, n, 3).collect()} == third
    uneven = rows.where("id < 59").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src <> 9 AND src <> 19")
    sizes = [r["count"] for r in multilevel.partition(uneven, n, 3).groupBy("part").count().collect()]
    assert len(sizes) == 3 and max(sizes) <= 21 and min(sizes) >= 19


def test_search_by_many_tasks(spark, monkeypatch):
    """Large searches go by tasks as their links ask for, and find what small ones do."""
    from kelvane.operators import graphs

    edges, pairs, _ = sparse(spark)
    search = lambda: {tuple(r) for r in graphs.bfs(edges, spark.range(3)).collect()}
    few, buckets, laid = search(), [], graphs.bucketed
    monkeypatch.setattr(graphs, "bucketed", lambda df, name, keys, n: buckets.append(n) or laid(df, name, keys, n))
    monkeypatch.setattr(graphs, "TASK_LINKS", 500)
    assert search() == few and buckets == [2 * len(pairs) * 3 // 500]


def test_large_levels_not_sent(spark, monkeypatch):
    """On levels of many vertices no join by vertex sends a table to all tasks, and the parts are those of joins that do."""
    import re

    from kelvane.operators import multilevel

    edges, _, n = sparse(spark, 700, 1500)
    split = lambda: {tuple(r) for r in multilevel.partition(edges, n).collect()}
    sent, written, plans = split(), multilevel.store, {}
    keep = lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name)
    monkeypatch.setattr(multilevel, "SENT", 300, raising=False)
    monkeypatch.setattr(multilevel, "store", keep)
    assert split() == sent
    assert {"wishes", "mapping", "coarse", "movers", "moves", "parts"} <= set(plans)
    by_vertex = re.compile(r"BroadcastHashJoin \[(id|src|dst|lead|csrc|cdst)#")
    assert not [name for name, some in plans.items() for plan in some if by_vertex.search(plan)]


@pytest.mark.parametrize("name", ["compare_reorderings", "best_method", "reordering_summary", "reordering_findings"])
def test_failed_method_fails_comparison(spark, even, monkeypatch, name):
    """A comparison without the method that failed would look like a whole one."""
    from kelvane.plans import methods

    def fails(m):
        raise ValueError("no order")

    monkeypatch.setitem(methods._methods, "block_reverse", fails)
    with pytest.raises(RuntimeError, match="block_reverse: no order"):
        catalog.queries()[name](spark, even).collect()


def test_blocks_are_read_where_they_lie(spark, monkeypatch):
    """Degrees and products of many blocks: blocks meet without an exchange, and only a number a row is shuffled."""
    import numpy as np

    from kelvane.operators import meeting, orderings, products

    m, cells = rectangle(spark)
    a = np.zeros((70, 80))
    a[tuple(zip(*cells))] = 1
    monkeypatch.setattr(meeting, "LEAST_CELLS", 10)
    monkeypatch.setattr(products, "GRAM_CELLS", 25)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    c = products.gram(m).entries
    assert "CartesianProduct" in plan(c) and "Exchange" not in plan(c)
    assert {(r["row"], r["col"]): r["val"] for r in c.collect()} == {(int(i), int(j)): (a @ a.T)[i, j] for i, j in zip(*np.nonzero(a @ a.T))}
    d = orderings.overlap_degrees(m.entries, 70, 20, 30)
    assert plan(d).count("Exchange") == 1
    assert {r["id"]: r["degree"] for r in d.collect()} == {i: int((a[i] @ a.T > 0).sum()) - 1 for i in range(70) if a[i].any()}
