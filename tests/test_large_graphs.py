"""Partitioning, dissection and colouring beyond one task: against brute force, and against what the small kernels give."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvane.matrix import SparseMatrix
from kelvane.operators import coloring, graphs, multilevel, partitions, spectral


def random_edges(n, m, seed, clusters=1, across=0):
    """About m edges a vertex, in rings of random order within clusters, and some across."""
    r, e = np.random.default_rng(seed), set()
    for c in range(clusters):
        for _ in range(m):
            p = r.permutation(np.arange(c, n, clusters))
            e |= {(min(a, b), max(a, b)) for a, b in zip(p.tolist(), np.roll(p, 1).tolist()) if a != b}
    e |= {(min(a, b), max(a, b)) for a, b in r.integers(0, n, (across, 2)).tolist() if a != b}
    return sorted(e)


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def cut(edges, part):
    return sum(part[a] != part[b] for a, b in edges)


def test_small_splits_are_the_best_ones():
    """Improved splits of twelve weighted vertices against all splits within the bounds."""
    for seed in range(4):
        r = np.random.default_rng(seed)
        a = np.triu((r.random((12, 12)) < 0.35) * r.integers(1, 4, (12, 12)), 1).astype(float)
        a, w = a + a.T, r.integers(1, 3, 12).astype(float)
        lo, hi = np.full(2, np.floor(w.sum() / 2)), np.full(2, np.ceil(w.sum() / 2))
        within = lambda p: (np.bincount(p, w, 2) >= lo).all() and (np.bincount(p, w, 2) <= hi).all()
        best = min(multilevel.cut_of(a, p) for p in (np.array(x) for x in itertools.product((0, 1), repeat=12)) if within(p))
        got = multilevel.split_dense(a, w, lo, hi)
        assert within(got) and multilevel.cut_of(a, got) == best


def test_moves_lower_the_cut_within_bounds(spark):
    edges, n = random_edges(120, 3, 1, 2, 20), 120
    nodes, links = multilevel.unit(frame(spark, edges), n)
    nodes = multilevel.grouped(nodes, [1 / 3] * 3)
    bounds = nodes.select("lo", "hi").first()
    parts, before = spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("part")), None
    for _ in range(4):
        part = {r["id"]: r["part"] for r in parts.collect()}
        sizes = np.bincount(list(part.values()), minlength=3)
        assert (sizes >= bounds["lo"]).all() and (sizes <= bounds["hi"]).all()
        assert before is None or cut(edges, part) <= before
        before = cut(edges, part)
        parts = multilevel.refine(nodes, links, parts, rounds=1)
    assert before < cut(edges, {i: i % 3 for i in range(n)})


def test_groups_are_split_apart(spark, monkeypatch):
    """Two graphs at once, one with isolated vertices: shares and bounds hold in each, and no edge between groups is needed."""
    monkeypatch.setattr(multilevel, "TASK_START", 100)
    edges = random_edges(300, 2, 3)
    both = edges + [(a + 300, b + 300) for a, b in edges]
    nodes = spark.range(640).select("id", F.when(F.col("id") < 300, "a").otherwise("b").alias("grp"), F.lit(1.0).alias("w"))
    got = {r["id"]: r["part"] for r in multilevel.split(nodes, frame(spark, both).withColumn("w", F.lit(1.0)), [0.25, 0.75]).collect()}
    assert set(got) == set(range(640))
    for ids in (range(300), range(300, 640)):
        share = sum(got[i] == 0 for i in ids) / len(ids)
        assert abs(share - 0.25) <= 0.25 * multilevel.TOLERANCE + 1 / len(ids)
    assert cut(both, got) < 0.375 * len(both)


def test_halves_of_halves(spark):
    edges = random_edges(500, 3, 4, 5, 40)
    got = {r["id"]: r["part"] for r in multilevel.bisected(frame(spark, edges), 500, 5).collect()}
    sizes = np.bincount(list(got.values()), minlength=5)
    assert len(sizes) == 5 and (abs(sizes - 100) <= 6).all() and cut(edges, got) < 0.5 * len(edges)


def test_spectral_clusters_equal_the_dense_kernel(spark):
    edges, n = random_edges(400, 5, 5, 4, 60), 400
    e = frame(spark, edges)
    values, vectors = spectral.eigenvectors(e, n, 4, accuracy=1e-6)
    a = partitions._adjacency(np.arange(n), *np.array(edges).T)
    want = np.linalg.eigvalsh(np.diag(a.sum(axis=0)) - a)[:4]
    assert np.allclose(values, want, atol=1e-6)
    x = np.array([list(r)[1:] for r in vectors.orderBy("id").collect()])
    assert np.allclose(x.T @ x, np.eye(4), atol=1e-6) and np.allclose((np.diag(a.sum(axis=0)) - a) @ x, x * values, atol=1e-3)
    got = {r["id"]: r["part"] for r in spectral.clusters(e, n, 4).collect()}
    assert got == {r["id"]: r["part"] for r in partitions.partition(e, n, 4, "spectral").collect()}


def test_large_graphs_take_the_other_way(spark, monkeypatch):
    """Above the bound of a task no method refuses."""
    edges = random_edges(200, 4, 6, 2, 10)
    monkeypatch.setattr(partitions, "TASK_NODES", 100)
    for method, k in (("metis", 2), ("recursive", 2)):
        got = {r["id"]: r["part"] for r in partitions.partition(frame(spark, edges), 200, k, method).collect()}
        assert cut(edges, got) <= 10 and sorted(np.bincount(list(got.values()))) == [100, 100]


def test_dissection_by_levels(spark):
    """Positions are a permutation, and on the first level the last rows separate the two parts before them."""
    n = 360
    edges = random_edges(n, 2, 7)
    cells = [(i, i, 1.0) for i in range(n)] + [(a, n + k, 1.0) for k, ab in enumerate(edges) for a in ab]
    m = SparseMatrix(spark.createDataFrame(cells, "row long, col long, val double"), n, n)
    rows = {r["new_pos"]: r["old_id"] for r in partitions.nested_dissection(m, 20, task_nodes=200).collect()}
    assert sorted(rows) == sorted(rows.values()) == list(range(n))
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    order = [rows[i] for i in range(n)]
    # From behind, the separator ends where what is before falls apart into pieces of at most half the rows and a tolerance.
    for size in range(0, n // 2):
        left, pieces = set(order[: n - size]), []
        while left:
            piece, front = set(), [next(iter(left))]
            while front:
                u = front.pop()
                if u in left:
                    left.remove(u)
                    piece.add(u)
                    front.extend(near[u] & left)
            pieces.append(len(piece))
        if max(pieces) <= 0.53 * n:
            break
    assert size < n // 3
    small = {r["new_pos"]: r["old_id"] for r in partitions.nested_dissection(m, 20, task_nodes=n).collect()}
    assert sorted(small.values()) == list(range(n))


def neighbours(edges, n):
    near = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def least(used):
    return next(c for c in itertools.count() if c not in used)


@pytest.fixture(scope="module")
def graph(spark):
    edges = random_edges(290, 2, 9, 1, 500)  # ten isolated vertices
    return edges, 300, frame(spark, edges), neighbours(edges, 300)


def colors_of(graph, strategy, **options):
    _, n, e, _ = graph
    out = {r["id"]: r["color"] for r in coloring.color(e, n, strategy, **options).collect()}
    assert set(out) == set(range(n)) and not any(out[a] == out[b] for a, b in graph[0])
    return out


def test_saturation(graph):
    _, n, _, near = graph
    color = {}
    while len(color) < n:
        u = min((v for v in range(n) if v not in color), key=lambda v: (-len({color[x] for x in near[v] if x in color}), -len(near[v]), v))
        color[u] = least({color[x] for x in near[u] if x in color})
    assert colors_of(graph, "saturation_largest_first") == color


@pytest.mark.parametrize("strategy", ["connected_sequential_bfs", "connected_sequential_dfs"])
def test_traversals(graph, strategy):
    _, n, _, near = graph
    order, seen = [], set()
    for start in range(n):
        front = [start]
        while front:
            u = front.pop(0 if strategy.endswith("bfs") else -1)
            if u not in seen:
                seen.add(u)
                order.append(u)
                front.extend(sorted(near[u] - seen, reverse=strategy.endswith("dfs")))
    color = {}
    for u in order:
        color[u] = least({color[x] for x in near[u] if x in color})
    assert colors_of(graph, strategy) == color
    if strategy not in coloring.SEQUENTIAL:
        assert colors_of(graph, strategy, task_edges=0) == color


def test_independent_sets(graph):
    _, n, _, near = graph
    color = colors_of(graph, "independent_set", seed=3)
    for v, c in color.items():
        assert all(any(color[x] == b for x in near[v]) for b in range(c))  # every set is maximal among what is left
    assert color != colors_of(graph, "independent_set", seed=4)


def test_cores(graph):
    _, n, e, near = graph
    left, core, k = {v: set(x) for v, x in enumerate(near)}, {}, 0
    while left:
        u = min(left, key=lambda v: (len(left[v]), v))
        k = max(k, len(left[u]))
        core[u] = k
        for x in left.pop(u):
            left[x].discard(u)
    assert {r["id"]: r["core"] for r in coloring.cores(e, n).collect()} == core
    for edges in (None, 0):
        got = colors_of(graph, "smallest_last", **({} if edges is None else {"task_edges": edges}))
        assert max(got.values()) <= max(core.values())


def test_mtx_source(spark, tmp_path):
    """Files by ranges of a few bytes, with comments, triangles and patterns; folders written by several tasks."""
    from kelvane.sources import files, mtx_source

    r = np.random.default_rng(3)
    cells = sorted({(int(a), int(b)) for a, b in r.integers(0, 40, (80, 2))})
    body = {"real": [f"{a + 1}  {b + 1} {(a - b) / 3!r}" for a, b in cells], "integer": [f"{a + 1} {b + 1} {a - b}" for a, b in cells], "pattern": [f" {a + 1} {b + 1}" for a, b in cells]}
    for field, lines in body.items():
        for symmetry in ("general", "symmetric", "skew-symmetric"):
            own = lines if symmetry == "general" else [x for x, (a, b) in zip(lines, cells) if a > b]
            path = str(tmp_path / f"{field}-{symmetry}.mtx")
            with open(path, "w") as f:
                f.write("\n".join([f"%%MatrixMarket matrix coordinate {field} {symmetry}", "% a comment", f"40 40 {len(own)}", *own[:9], "% another", *own[9:]]) + ("\n" if field == "real" else ""))
            want = {tuple(x) for x in files.read_mtx(spark, path).entries.collect()}
            for size in (50, 10**6) if field != "integer" else (7,):
                got = mtx_source.read(spark, path, size)
                assert {tuple(x) for x in got.entries.collect()} == want and (got.nrows, got.ncols) == (40, 40)
    assert spark.read.format("mtx").option("rangebytes", 40).load(path).rdd.getNumPartitions() > 3
    m, folder = mtx_source.read(spark, str(tmp_path / "real-general.mtx")), str(tmp_path / "folder")
    for mode in ("append", "overwrite"):
        mtx_source.write(SparseMatrix(m.entries.repartition(3), 40, 40), folder, mode)
        back = mtx_source.read(spark, folder, 300)
        assert (back.nrows, back.ncols) == (40, 40)
        assert {tuple(x) for x in back.entries.collect()} == {tuple(x) for x in m.entries.collect()}
    empty = str(tmp_path / "empty")
    mtx_source.write(SparseMatrix(m.entries.where("false"), 3, 2), empty)
    assert mtx_source.read(spark, empty).entries.count() == 0
    for text in ("no header\n1 1 1\n", "%%MatrixMarket matrix array real general\n1 1\n1\n", "%%MatrixMarket matrix coordinate real general\n"):
        (tmp_path / "odd.mtx").write_text(text)
        with pytest.raises(ValueError):
            mtx_source.read(spark, str(tmp_path / "odd.mtx"))


def all_distances(near):
    n, out = len(near), []
    for s in range(n):
        level, front = {s: 0}, [s]
        while front:
            front = list({v for u in front for v in near[u] if v not in level})
            level |= dict.fromkeys(front, max(level.values()) + 1)
        out.append(level)
    return out


def test_distances_without_all_pairs(spark, monkeypatch):
    """A long way hangs on a dense graph: the diameter is exact from few sources, the average within five percent."""
    edges, n = random_edges(150, 3, 11) + [(i - 1, i) for i in range(150, 154)], 154
    far = all_distances(neighbours(edges, n))
    want, mean = max(max(x.values()) for x in far), sum(sum(x.values()) for x in far) / (n * (n - 1))
    e = frame(spark, edges)
    monkeypatch.setattr(graphs, "ALL_PAIRS", 100)
    one = graphs.distances(e, n).first()
    assert one["diameter"] == want and abs(one["average_shortest_path"] / mean - 1) < 0.05
    assert graphs.diameter(e, n, batch=5) == want and graphs.diameter(e, n + 1) is None


def test_distances_exact_at_any_size(spark, monkeypatch):
    """Distances do not depend on how many vertices are listed pair by pair, held by a task, or folded where they hang."""
    edges, n = random_edges(150, 3, 11) + [(i - 1, i) for i in range(150, 154)] + [(i % 40, i) for i in range(154, 300)], 300
    far = all_distances(neighbours(edges, n))
    ways = sum(sum(x.values()) for x in far)
    e = frame(spark, edges)
    monkeypatch.setattr(graphs, "ALL_PAIRS", 100)
    assert tuple(graphs.distances(e, n).first()) == (max(max(x.values()) for x in far), round(ways / (n * (n - 1)), 6))
    assert graphs.properties(e, n).first()["average_shortest_path"] == round(ways / (n * (n - 1)), 6)
    assert tuple(graphs.distances(e, n + 1).first()) == (None, None)
    monkeypatch.setattr(graphs, "BATCH", 100)
    assert graphs.distance_sum(e, n, core_links=10) == ways
    star = [(0, i) for i in range(1, 150)]
    assert graphs.distance_sum(frame(spark, star), 150) == 2 * 149 + 149 * 148 * 2


def test_layouts_that_stay(spark):
    """Products with a bucketed or packed matrix shuffle no entry of it, and give what the others give."""
    from kelvane.operators import products

    g = np.random.default_rng(2)
    a = np.where(g.random((70, 50)) < 0.2, g.integers(1, 9, (70, 50)), 0).astype(float)
    a[5] = 0
    m = SparseMatrix(spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, col long, val double"), 70, 50)
    x = g.integers(-3, 4, 50).astype(float)
    v = spark.createDataFrame(list(enumerate(x.tolist())), "idx long, val double")
    laid, blocks = m.bucketed("col"), products.packed(m, 16)
    for y in (products.spmv(laid, v), products.spmv_packed(blocks, m, v, 16)):
        assert {r["idx"]: r["val"] for r in y.collect()} == dict(enumerate((a @ x).tolist()))
        plan = y._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 3  # of the vector, of the sums by row, of the row numbers
    assert products.spmv(m, v)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    assert laid.bucketed("row").entries.count() == int((a != 0).sum())
