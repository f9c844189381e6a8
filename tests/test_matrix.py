import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvane.matrix import SparseMatrix
from kelvane.operators import coloring, graphs, metrics, multilevel, numbering, orderings, partitions, products
from kelvane.plans import methods, plotdata
from kelvane.sources import files, generators

MX1 = [[1, 0, 2, 0], [0, 3, 0, 4], [5, 0, 6, 0], [0, 7, 0, 8]]
MX2 = [[1, 0, 1, 0], [0, 1, 1, 0], [1, 1, 0, 1], [0, 0, 1, 1]]


def make(spark, dense):
    a = np.array(dense, float)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return SparseMatrix.of(spark.createDataFrame(cells, "row long, col long, val double"), *a.shape)


def dense(m):
    a = np.zeros((m.nrows, m.ncols))
    for r in m.entries.collect():
        a[r["row"], r["col"]] = r["val"]
    return a


def tri(n):
    return np.eye(n) + np.eye(n, k=1) + np.eye(n, k=-1)


def order(perm):
    rows = {r["new_pos"]: r["old_id"] for r in perm.collect()}
    assert sorted(rows) == sorted(rows.values()) == list(range(len(rows)))
    return [rows[k] for k in range(len(rows))]


@pytest.mark.parametrize("strategy", ["shuffle", "broadcast", "blocked"])
def test_spmv(spark, strategy):
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "idx long, val double")
    y = products.spmv(make(spark, MX1), x, strategy).orderBy("idx").collect()
    assert [r["val"] for r in y] == [7, 22, 23, 46]


def test_spmv_length(spark):
    x = spark.createDataFrame([(0, 1.0)], "idx long, val double")
    with pytest.raises(ValueError):
        products.check_length(make(spark, MX1), x)
    three = spark.createDataFrame([(i, 1.0) for i in range(3)], "idx long, val double")
    twice = spark.createDataFrame([(i, 1.0) for i in (0, 1, 1, 4)], "idx long, val double")
    for strategy in ("shuffle", "broadcast", "blocked"):
        for v in (three, twice):
            with pytest.raises(ValueError):
                products.spmv(make(spark, np.eye(5)), v, strategy)


def test_spmv_joins(spark):
    """Each form makes the join that it is named after."""
    x = spark.createDataFrame([(i, 1.0) for i in range(4)], "idx long, val double")
    kinds = {s: products.spmv(make(spark, MX1), x, s)._jdf.queryExecution().executedPlan().toString() for s in ("shuffle", "broadcast", "blocked")}
    assert "SortMergeJoin [col" in kinds["shuffle"] and "SortMergeJoin [col" in kinds["blocked"] and "SortMergeJoin [col" not in kinds["broadcast"]


@pytest.mark.parametrize("a,width,profile", [(MX1, 2, 8), (MX2, 2, 7), (tri(5), 1, 9)])
def test_metrics(spark, a, width, profile):
    m = make(spark, a)
    assert metrics.bandwidth(m).first()[0] == width
    assert metrics.profile(m).first()[0] == profile


def test_wavefront(spark):
    m = make(spark, tri(5))
    assert metrics.max_wavefront(m).first()[0] == 5
    assert [r["active"] for r in metrics.wavefront_curve(m).orderBy("row").collect()] == [5, 4, 3, 2, 1]


def test_characteristics(spark):
    m = make(spark, tri(100))
    r = metrics.spmv_characteristics(m).first()
    assert (r["row_avg"], r["avg_access_stride"], r["memory_irregularity"], r["recommendations"]) == (2.98, 1.0, 0.942809, "vectorized,coo_format")


def test_empty(spark):
    m = make(spark, np.zeros((5, 5)))
    assert metrics.bandwidth(m).first()[0] == 0
    assert metrics.sparsity_summary(m).first()["pattern_type"] == "empty"
    assert order(orderings.king(m)) == list(range(5))
    assert coloring.color(graphs.row_overlap(m), 5).where("color > 0").isEmpty()


def test_overlap_and_coloring(spark):
    e = graphs.row_overlap(make(spark, tri(5)))
    assert e.count() == 7
    k4 = graphs.row_overlap(make(spark, MX2))
    for s in coloring.STRATEGIES:
        q = coloring.quality(k4, coloring.color(k4, 4, s)).first()
        assert q["num_colors"] == 4 and q["is_valid"]
    with pytest.raises(ValueError):
        coloring.color(k4, 4, "none")


def test_rounds_equal_the_kernel(spark):
    a = (np.random.default_rng(1).random((30, 30)) < 0.08).astype(float)
    e = graphs.row_overlap(make(spark, a))
    one = {tuple(r) for r in coloring.color(e, 30).collect()}
    assert one == {tuple(r) for r in coloring.color(e, 30, task_edges=0).collect()}


def test_one_order_at_every_size(spark):
    """What a method gives does not change with the graph's size; where it cannot go on it says so."""
    a = (np.random.default_rng(2).random((30, 30)) < 0.08).astype(float)
    e = graphs.row_overlap(make(spark, a))
    for s in ("largest_first", "random_sequential"):
        assert {tuple(r) for r in coloring.color(e, 30, s, seed=5).collect()} == {tuple(r) for r in coloring.color(e, 30, s, seed=5, task_edges=0).collect()}
    for s in coloring.SEQUENTIAL:
        with pytest.raises(ValueError):
            coloring.color(e, 30, s, task_edges=0)
    for method in partitions.METHODS:
        assert partitions.partition(e, 30, 4, method).count() == 30
    with pytest.raises(ValueError):
        partitions.partition(e, 30, 4, "odd")


def test_numbering(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(r.integers(0, 9, (500, 2)))]
    df = spark.createDataFrame(rows, "part int, place int, n int").repartition(7)
    want = sorted(rows)
    assert sorted((x["number"], x["part"], x["place"]) for x in numbering.numbered(df, "part", "place").collect()) == [(k, a, b) for k, (a, b, _) in enumerate(want)]
    sums = np.cumsum([n for _, _, n in want[::-1]]).tolist()
    got = numbering.running(df, "n", df["part"].desc(), df["place"].desc()).collect()
    assert [x["sum"] for x in sorted(got, key=lambda x: (-x["part"], -x["place"]))] == sums
    assert numbering.numbered(df.where("n > 99"), "part", "place").count() == 0


def test_hot_columns(spark):
    """A column of many rows is paired block by block; too many pairs are refused before any is made."""
    a = (np.random.default_rng(6).random((40, 12)) < 0.15).astype(float)
    a[:, 3] = a[:33, 5] = 1
    m = make(spark, a)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if (a[i] * a[j]).any()}
    for block in (3, 7, 2048):
        assert {tuple(r) for r in graphs.row_overlap(m, block).collect()} == want
    with pytest.raises(ValueError):
        graphs.row_overlap(m, most=700)


def test_components_and_levels(spark):
    r = np.random.default_rng(7)
    pairs = {(int(min(x)), int(max(x))) for x in r.integers(0, 300, (220, 2)) if x[0] != x[1]} | {(k, k + 1) for k in range(300, 360)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    near = {i: set() for i in range(370)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def reach(s):
        level, front = {s: 0}, [s]
        while front:
            front = list({v for u in front for v in near[u] if v not in level})
            level |= dict.fromkeys(front, max(level.values()) + 1)
        return level

    assert {x["id"]: x["component"] for x in graphs.components(e, 370).collect()} == {i: min(reach(i)) for i in range(370)}
    got = graphs.bfs(e, spark.createDataFrame([(0,), (330,)], "id long")).collect()
    assert {(x["source"], x["id"]): x["level"] for x in got} == {(s, i): k for s in (0, 330) for i, k in reach(s).items()} and len(got) == len(reach(0)) + len(reach(330))
    one = graphs.properties(e, 370).first()
    assert not one["is_connected"] and one["num_components"] == len({min(reach(i)) for i in range(370)}) and one["diameter"] is None
    assert sum(x["components"] * x["size"] for x in one["component_sizes"]) == 370
    parts = {x["id"]: x["part"] for x in partitions.partition(e, 370, 3, "multilevel").collect()}
    assert len(parts) == 370 and set(parts.values()) == {0, 1, 2}


def test_structure_and_symmetry(spark):
    for a, symmetric in ((tri(6), True), (MX1, False), (MX2, True), (np.diag([1.0, 0, 2]), True), (tri(6) + np.triu(tri(6)), False)):
        a = np.array(a, float)
        assert metrics.matrix_properties(make(spark, a)).first()["is_symmetric"] == symmetric == bool((a == a.T).all())
    a = (np.random.default_rng(9).random((30, 20)) < 0.1).astype(float)
    r, n = metrics.structure(make(spark, a)).first(), (a != 0).sum(axis=1)
    assert (r["row_avg"], r["row_std"], r["row_min"], r["row_max"], r["row_empty"]) == (round(n.mean(), 6), round(n.std(), 6), n.min(), n.max(), (n == 0).sum())
    assert r["row_distribution"] == np.histogram(n, 10)[0].tolist() and r["density"] == round(a.sum() / 600, 9)
    use = {x["format"]: x for x in metrics.memory_usage(make(spark, MX1)).collect()}
    assert use["csr"]["overhead_bytes"] == 0 and use["coo"]["overhead_bytes"] == 128 - use["csr"]["bytes"] and use["dok"]["error"]
    sums = plotdata.value_sum_histogram(make(spark, MX1)).collect()
    assert [x["n"] for x in sorted(sums)] == np.histogram(np.array(MX1).sum(axis=1), 4)[0].tolist()
    tables = plotdata.comprehensive({"A b": make(spark, MX1), "c": make(spark, MX2)})
    assert set(tables) == {"sparsity_comparison", "bandwidth_evolution", "a_b_bandwidth_profile", "a_b_nnz_distribution", "c_bandwidth_profile", "c_nnz_distribution"}
    assert {(x["name"], x["bandwidth"]) for x in tables["bandwidth_evolution"].collect()} == {("A b", 2), ("c", 2)}
    assert plotdata.report(make(spark, MX1), {"x": make(spark, MX2)})["sparsity_comparison"].count() == 17


def test_least_hashes(spark):
    rows = [(int(h), i) for i, h in enumerate(np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 400))] + [(5, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "h long, cell long")
    for k in (0, 1, 190, 225, 450, 999):
        assert sorted((x["h"], x["cell"]) for x in generators.least(df, k, "h", "cell").collect()) == sorted(rows)[:k]


def test_archives(spark, tmp_path):
    import tarfile

    (tmp_path / "in").mkdir()
    files.save(make(spark, MX1), str(tmp_path / "in" / "x.mtx"))
    (tmp_path / "in" / "readme.txt").write_text("text")
    with tarfile.open(tmp_path / "some.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "in" / "readme.txt", "some/readme.txt")
        tar.add(tmp_path / "in" / "x.mtx", "../../some/x.mtx")
    m = files.load(spark, "some", str(tmp_path / "none"), files.downloader(f"file://{tmp_path}/", str(tmp_path / "got")))
    assert np.array_equal(dense(m), np.array(MX1)) and files.available(str(tmp_path / "got")) == ["some"]
    with tarfile.open(tmp_path / "bare.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "in" / "readme.txt", "readme.txt")
    with pytest.raises(ValueError):
        files.unpack(str(tmp_path / "bare.tar.gz"), str(tmp_path / "got"))


def test_rcm(spark):
    a = np.eye(12)
    p = np.random.default_rng(3).permutation(12)
    a += tri(12)[np.ix_(p, p)]
    m = make(spark, a)
    perm = orderings.rcm(m)
    order(perm)
    assert metrics.bandwidth(m.gather(perm, perm)).first()[0] == 1
    levels = orderings.reverse_cuthill_mckee(graphs.pattern_graph(m), 12, task_edges=0)
    assert order(levels) == order(perm)


def test_isolated_rows_stay(spark):
    m = make(spark, np.diag([1.0, 2, 3, 4]))
    for r in methods.reorder(m, ["largest_first", "rcm", "king", "diagonal", "partition_recursive"]).values():
        assert r.error is None and sorted(order(r.rows)) == [0, 1, 2, 3] and r.matrix.entries.count() == 4


def test_permuted_product(spark):
    a = np.random.default_rng(5).integers(0, 3, (12, 12)).astype(float)
    m, x = make(spark, a), np.arange(12.0)
    perm = orderings.rcm(m)
    o = order(perm)
    v = spark.createDataFrame([(i, float(x[o[i]])) for i in range(12)], "idx long, val double")
    y = [r["val"] for r in products.spmv(m.gather(perm, perm), v).orderBy("idx").collect()]
    assert np.allclose(y, (a @ x)[o])


def test_products(spark):
    m = make(spark, MX1)
    assert np.array_equal(dense(products.spgemm(m, m.transpose())), np.array(MX1) @ np.array(MX1).T)
    assert np.array_equal(dense(m.add(m.transpose())), np.array(MX1) + np.array(MX1).T)
    assert np.array_equal(dense(m.slice((1, 3), (0, 2))), np.array(MX1)[1:3, 0:2])


def test_graph_analytics(spark):
    star = spark.createDataFrame([(0, k) for k in range(1, 6)], "src long, dst long")
    cycle = spark.createDataFrame([(k, k + 1) for k in range(7)] + [(0, 7)], "src long, dst long")
    assert graphs.distances(star, 6).first()[0] == 2 and graphs.distances(cycle, 8).first()[0] == 4
    assert graphs.average_clustering(star, 6).first()["average_clustering"] == 0
    assert graphs.components(cycle, 10).select("component").distinct().count() == 3
    tri3 = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")
    assert graphs.average_clustering(tri3, 3).first()[0] == 1


@pytest.mark.parametrize("method", [*partitions.METHODS])
def test_partitions(spark, method):
    e = graphs.row_overlap(make(spark, np.kron(np.eye(4), np.ones((8, 8))) + np.eye(32, k=1)))
    parts = partitions.partition(e, 32, 4, method).collect()
    assert sorted(r["id"] for r in parts) == list(range(32)) and len({r["part"] for r in parts}) <= 4


def test_kernighan_lin_and_dissection(spark):
    a = np.kron(np.eye(2), np.ones((6, 6)))
    np.fill_diagonal(a, 0)
    a[5, 6] = a[6, 5] = 1
    side = partitions.kernighan_lin(a, 1)
    assert a[side[:, None] != side[None]].sum() == 2
    order(partitions.nested_dissection(make(spark, tri(20)), 4))
    with pytest.raises(ValueError):
        partitions.nested_dissection(make(spark, [[1, 0, 1], [0, 1, 0]]))


def test_multilevel_coarsens(spark, monkeypatch):
    monkeypatch.setattr(multilevel, "TASK_START", 100)
    e = spark.createDataFrame([(k, k + 1) for k in range(299)], "src long, dst long")
    parts = {r["id"]: r["part"] for r in partitions.multilevel(e, 300, 2).collect()}
    sizes = [list(parts.values()).count(p) for p in (0, 1)]
    assert len(parts) == 300 and min(sizes) >= 142 and sum(parts[k] != parts[k + 1] for k in range(299)) == 1


def test_stars_shrink(spark):
    """Leaves of one hub merge among themselves, never with those of another; weights are added up."""
    star = [(0, i) for i in range(2, 302)] + [(1, i) for i in range(302, 402)]
    nodes = multilevel.grouped(spark.range(402).select("id", F.lit("").alias("grp"), F.lit(1.0).alias("w")), [0.5, 0.5])
    mapping, nodes, up = multilevel.coarsen(nodes, spark.createDataFrame([(a, b, 1.0) for a, b in star], "src long, dst long, w double"))
    coarse, weight = {r["id"]: r["lead"] for r in mapping.collect()}, {r["id"]: r["w"] for r in nodes.collect()}
    assert len(coarse) == 402 and set(weight) == set(coarse.values()) and len(weight) < 0.6 * 402
    assert all(w == sum(c == i for c in coarse.values()) <= nodes.first()["most"] for i, w in weight.items())
    sides = [{coarse[i] for i in x} for x in ((0, *range(2, 302)), (1, *range(302, 402)))]
    assert not sides[0] & sides[1]
    want = {}
    for a, b in star:
        if coarse[a] != coarse[b]:
            want[tuple(sorted((coarse[a], coarse[b])))] = want.get(tuple(sorted((coarse[a], coarse[b]))), 0) + 1
    assert {(r["src"], r["dst"]): r["w"] for r in up.collect()} == want


def test_files(spark, tmp_path):
    m = make(spark, MX1)
    for name in ("a.mtx", "b.npz", "c.parquet"):
        files.save(m, str(tmp_path / name))
        assert np.array_equal(dense(files.load(spark, str(tmp_path / name))), np.array(MX1))
    assert files.available(str(tmp_path)) == ["a", "b"] and files.available(str(tmp_path / "none")) == []
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 2\n2 1\n3 3\n")
    assert dense(files.read_mtx(spark, str(tmp_path / "s.mtx"))).tolist() == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]
    (tmp_path / "d.mtx").write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n0\n4\n")
    assert dense(files.read_mtx(spark, str(tmp_path / "d.mtx"))).tolist() == [[1, 0], [2, 4]]
    with pytest.raises(FileNotFoundError):
        files.load(spark, "nothing", str(tmp_path))


def mat_file(variables, order="<", packed=False):
    """A MATLAB level-5 file: (name, class, flags, dimensions, further elements) of each variable."""
    import struct
    import zlib

    def element(kind, data):
        if 0 < len(data) <= 4 and kind != 14:
            return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"text".ljust(124) + struct.pack(order + "H", 0x100) + (b"IM" if order == "<" else b"MI")
    for name, kind, flags, shape, more in variables:
        inner = element(6, struct.pack(order + "II", flags << 8 | kind, 0)) + element(5, np.array(shape, order + "i4").tobytes()) + element(1, name)
        whole = element(14, inner + b"".join(element(k, np.asarray(v, order + t).tobytes()) for k, t, v in more))
        out += struct.pack(order + "II", 15, len(z := zlib.compress(whole))) + z if packed else whole
    return out


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_matlab(spark, tmp_path, order, packed):
    a = np.array(MX1, float)
    col, row = np.nonzero(a.T)
    text = (b"note", 4, 0, (1, 2), [(4, "u2", [104, 105])])
    sparse = (b"s", 5, 0, a.shape, [(5, "i4", [*row, 0]), (5, "i4", [0, *np.cumsum((a != 0).sum(axis=0))]), (9, "f8", [*a.T[col, row], 0])])
    grid = (b"longer_name", 6, 0, (2, 3), [(2, "u1", [1, 0, 0, 4, 5, 0])])
    for name, variables, want in (("s", [text, sparse, grid], a), ("g", [grid, sparse], [[1, 0, 5], [0, 4, 0]])):
        (tmp_path / f"{name}.mat").write_bytes(mat_file(variables, order, packed))
        m = files.load(spark, name, str(tmp_path))
        assert dense(m).tolist() == np.asarray(want).tolist()
    assert files.available(str(tmp_path)) == ["g", "s"]


def test_matlab_refused(spark, tmp_path):
    from kelvane.sources import matlab

    for raw in (b"", b"x" * 200, mat_file([(b"note", 4, 0, (1, 2), [(4, "u2", [104, 105])])]), mat_file([(b"c", 6, 8, (1, 1), [(9, "f8", [1.0]), (9, "f8", [2.0])])])):
        with pytest.raises(ValueError):
            matlab.first_matrix(raw)


def test_generators(spark):
    assert generators.generate(spark, 50, 40, 0.1).entries.distinct().count() == 200
    for p in generators.PATTERNS:
        a, b = (sorted(map(tuple, generators.generate(spark, 40, 40, 0.1, p, seed=3).entries.collect())) for _ in range(2))
        assert a == b and a
    assert generators.generate(spark, 5, 5, 0.0).entries.count() == 5
    with pytest.raises(ValueError):
        generators.generate(spark, 5, 5, 0.1, "x")


def test_methods(spark, tmp_path):
    m = make(spark, tri(12))
    methods.register("fails", lambda m: 1 / 0)
    r = methods.reorder(m, ["king", "fails"])
    assert r["fails"].error and r["king"].error is None
    top = methods.ranking(methods.comparison(m, r)).first()
    assert top["method"] == "king"
    known = methods.findings(methods.comparison(m, r), {"a": coloring.quality(e := graphs.row_overlap(m), coloring.color(e, 12))}).first()
    assert (known["methods"], known["improving"], known["best_method"], known["min_colors"]) == (1, int((top["improvement_pct"] or 0) > 0), "king", 3)
    with pytest.raises(ValueError):
        methods.reorder(m, ["no such"])
    x = spark.range(12).selectExpr("id AS idx", "1.0D AS val")
    out = methods.benchmark_spmv(m, x, ("shuffle", "odd"), 0, 1)
    assert out["shuffle"]["avg_time_ms"] > 0 and "error" in out["odd"]
    methods.save_results(out, str(tmp_path / "r.json"))
    assert methods.load_results(str(tmp_path / "r.json")).keys() == out.keys()
    assert "shuffle" in open(methods.write_report({"method_comparison": out}, str(tmp_path / "r.txt"))).read()
    assert "shuffle" in methods.report({"method_comparison": out}) and "odd" not in methods.report({"method_comparison": out})
